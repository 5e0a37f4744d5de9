"""Comments and literals hold no code."""

from pyspark.sql import functions as F

from fathomline.sources import extract

FILES = [
    """export const a = 1; // export const no1 = 1
/* export * from 'no2' */ export { b } from "./b"; /* open
export const no3""",
    """const s = 'export const no1 = 1'; const t = "it's \\" export class no2"; const u = `export function no3() {}
import './no4' ${x}`; export let c = '//'; export type D = "/*"; export enum E {}""",
    """import def, { x as y } from './static';
import './effect'; const m = await import( './dynamic' ); const r = require("./required"); import type { T } from './types'; export default 5""",
    "const open = 'no end\nexport const f = 1\nconst q = \"\\\\\"; export const g = '\\''",
    "x" * 300_000 + "; export const h = '" + "a\\'" * 20_000 + "'; export const i = 1",
]


def symbols(spark, text):
    df = spark.createDataFrame([("p", text)], "path string, text string")
    return {(r.role, r.name, r.source, r.kind) for r in extract.module_symbols(df).collect()}


def test_only_code_counts(spark):
    exports = lambda rows: {n for role, n, _, _ in rows if role == "export"}
    first = symbols(spark, FILES[0])
    assert exports(first) == {"a"} and ("reexport", "b", "./b", "static") in first and ("import", "./b", "./b", "static") in first and len(first) == 3
    assert symbols(spark, FILES[1]) == {("export", n, None, None) for n in ("c", "D", "E")}
    assert exports(symbols(spark, FILES[3])) == {"f", "g"}
    assert exports(symbols(spark, FILES[4])) == {"h", "i"}


def test_kinds_of_imports(spark):
    got = {(source, kind) for role, _, source, kind in symbols(spark, FILES[2]) if role == "import"}
    assert got == {("./static", "static"), ("./effect", "static"), ("./dynamic", "dynamic"), ("./required", "require"), ("./types", "static")}


def test_masks(spark):
    df = spark.createDataFrame([("a'x'b//c\n\"d\\\"\"/*e*/`f`",), ("",), (None,)], "text string").coalesce(1)
    code, literals = extract.masked(F.col("text"))
    rows = df.select(code.alias("code"), literals.alias("literals")).collect()
    assert (rows[0].code, rows[0].literals) == ("a'0'b \n\"2\" `4`", ["x", "/", "d\\\"", "*e*", "f"])
    assert rows[1].code == "" and rows[2].code is None
