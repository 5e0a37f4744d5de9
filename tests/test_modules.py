"""Module resolution against a plain search with the standard library's paths."""

import json
import posixpath
import random

from pyspark.sql import functions as F

from fathomline.operators import modules

END = ["", ".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx"]


def normal(path):
    """What the published paths do: a slash at the end stays."""
    out = posixpath.normpath(path) if path else "."
    out = out[1:] if out.startswith("//") else out
    return out + "/" if path.endswith("/") and out != "/" else out


def find(base, there):
    bare = next((base[: -len(e)] for e in (".mjs", ".cjs", ".jsx", ".js") if base.endswith(e)), base)
    return next((c for c in [base, *(bare + e for e in END)] if c in there), None)


def plain(path, specifier, configs, there):
    folder = lambda p: posixpath.dirname(p) or "."
    if specifier.startswith(".") and (got := find(normal(f"{folder(path)}/{specifier}"), there)):
        return got
    near = [c for c in configs if folder(c) == "." or path.startswith(folder(c) + "/")]
    for c in sorted(near, key=lambda c: (-len(folder(c)), c)):
        base = normal(f"{folder(c)}/{configs[c].get('baseUrl', '.')}")
        for pattern in sorted(configs[c]["paths"]):
            if pattern.count("*") > 1:
                continue
            if "*" in pattern:
                start, end = pattern.split("*")
                if not (specifier.startswith(start) and specifier.endswith(end)):
                    continue
                capture = specifier[len(start) : max(len(start), len(specifier) - len(end))]
            elif pattern == specifier:
                capture = ""
            else:
                continue
            for target in configs[c]["paths"][pattern]:
                mapped = normal(f"{base}/{target.replace('*', capture, 1)}")
                if mapped == ".." or mapped.startswith(("../", "/")):
                    continue
                if got := find(mapped, there):
                    return got
    return None


def resolved(spark, imports, configs, there):
    files = [(c, json.dumps({"compilerOptions": o})) for c, o in configs.items()]
    frame = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(imports)], "import_id long, path string, specifier string")
    parsed = modules.parse_configs(spark.createDataFrame(files, "path string, text string"))
    out = modules.resolve(frame, parsed, spark.createDataFrame([(p,) for p in there], "path string")).collect()
    got = {r.import_id: r.path for r in out}
    assert len(got) == len(out)
    return [got.get(i) for i in range(len(imports))]


def test_paths(spark):
    cases = ["a/b", "a//b/./c", "a/../b", "../a", "a/../../b", "./", ".", "", "a/", "/a/../..", "/", "a/b/../..", "../../x/..", "/x/"]
    got = [r.n for r in spark.createDataFrame([(c,) for c in cases], "x string").coalesce(1).select(modules.normal_path(F.col("x")).alias("n")).collect()]
    assert got == ["a/b", "a/b/c", "b", "../a", "../b", "./", ".", ".", "a/", "/", "/", ".", "../..", "/x/"]


def test_literal_cases(spark):
    there = ["src/a.ts", "src/b.tsx", "src/lib/index.ts", "src/types.d.ts", "src/both.js", "src/both.ts", "packages/core/src/x.ts", "packages/core/src/deep/y.ts", "generated/x.ts", "vendor/lodash.d.ts", "up.ts", "src/file.js.ts"]
    configs = {"tsconfig.json": {"baseUrl": ".", "paths": {"@core/*": ["packages/core/src/*", "generated/*"], "lodash": ["vendor/lodash"], "@two/*/*": ["src/*"], "*.gen": ["generated/*"], "out/*": ["../*"], "@any*": ["src/*"]}}, "src/tsconfig.json": {"paths": {"@core/x": ["./a"], "self/*": ["*"]}}}
    cases = {
        ("src/main.ts", "./a"): "src/a.ts", ("src/main.ts", "./a.js"): "src/a.ts", ("src/main.ts", "./b.jsx"): "src/b.tsx", ("src/main.ts", "./lib"): "src/lib/index.ts", ("src/main.ts", "../up"): "up.ts", ("src/main.ts", "./types"): "src/types.d.ts",
        ("src/main.ts", "./both.js"): "src/both.js", ("src/main.ts", "./both"): "src/both.ts", ("src/main.ts", "./file.js.js"): "src/file.js.ts", ("src/main.ts", "../../../up"): None, ("src/main.ts", "./lib/"): None, ("src/main.ts", "a"): None,
        ("src/main.ts", "@core/x"): "src/a.ts", ("other.ts", "@core/x"): "packages/core/src/x.ts", ("src/main.ts", "@core/deep/y.js"): "packages/core/src/deep/y.ts", ("other.ts", "lodash"): "vendor/lodash.d.ts", ("other.ts", "lodash/x"): None,
        ("other.ts", "@two/a/b"): None, ("other.ts", "x.gen"): "generated/x.ts", ("other.ts", "out/up"): None, ("other.ts", "@anya"): "src/a.ts", ("src/deep/q.ts", "self/a"): "src/a.ts", ("other.ts", "self/a"): None,
    }
    assert dict(zip(cases, resolved(spark, list(cases), configs, there), strict=True)) == cases
    assert all(plain(p, s, configs, set(there)) == w for (p, s), w in cases.items())


def test_random_projects(spark):
    r = random.Random(8)
    names, ends = ["a", "b", "lib", "core"], ["", ".ts", ".js", ".d.ts", "/index.ts", ".tsx"]
    path = lambda n: "/".join(r.choice(names) for _ in range(n))
    there = sorted({path(r.randrange(1, 4)) + r.choice(ends[1:]) for _ in range(60)})
    patterns, targets = ["@x/*", "@x/a/*", "*", "b", "*/a", "@x/*/*", "lib/*.js", "a*b", "core/a"], ["*", "lib/*", "core/*/a", "../*", "./a", "*.ts", "a/*"]
    configs = {(f"{path(n)}/" if n else "") + name: {"baseUrl": r.choice([".", "..", "lib", "./core/"]), "paths": {r.choice(patterns): r.sample(targets, 2) for _ in range(3)}} for n, name in ((0, "tsconfig.json"), (1, "tsconfig.json"), (1, "jsconfig.json"), (2, "tsconfig.json"))}
    specifiers = ["./a", "../a", "../lib/b.js", "./core", "@x/a", "@x/a/b", "b", "lib/a.js", "core/a", "ab", "aab", "@x/lib/core.js", "x/a", "..", "./", "core/a/"]
    imports = [(path(r.randrange(1, 4)) + ".ts", r.choice(specifiers)) for _ in range(300)]
    want = [plain(p, s, configs, set(there)) for p, s in imports]
    assert resolved(spark, imports, configs, there) == want and sum(w is not None for w in want) > 60


def test_bounds_and_text_that_is_none(spark):
    many = {f"p{i:03d}": ["a"] for i in range(300)} | {"": ["a"], "n": [], "x" * 513: ["a"]}
    rows = [("tsconfig.json", json.dumps({"compilerOptions": {"baseUrl": "b" * 600, "paths": many}})), ("bad/tsconfig.json", "{not json"), ("c/tsconfig.json", '{/* why */ "compilerOptions": {"paths": {"k": ["1"]}}}'), ("d/tsconfig.json", "{}"), ("e/tsconfig.json", None)]
    out = modules.parse_configs(spark.createDataFrame(rows, "path string, text string")).collect()
    top = [x for x in out if x.config == "tsconfig.json"]
    assert {x.base for x in top} == {"."} and max(x.rank for x in top) <= 255 and all(0 < len(x.pattern) <= 512 for x in top)
    assert [(x.base, x.pattern) for x in out if x.config == "c/tsconfig.json"] == [("c", "k")] and {x.folder for x in out} == {".", "c"}
