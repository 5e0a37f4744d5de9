"""Queries over trees as a source, identities of contracts and records that are taken once, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import identity
from ..operators import modules
from ..sources import trees
from ..sources.tables import BINDINGS, relation, relation_sql, shared_dir, table
from ..streaming.ledger import LedgerSink

C = F.col
#: Two commits a repository: of the second the trees of some have a record that is none.
BINDINGS["tree_records"] = """
    SELECT repository, concat(md5(repository), substr(md5(c), 1, 8)) AS commit, CASE WHEN c = 'second' AND entry_kind = 'submodule' AND length(repository) % 2 = 0 THEN concat(path, '//x') WHEN c = 'second' THEN concat('next/', path) ELSE path END AS path,
           CASE entry_kind WHEN 'symlink' THEN '120000' WHEN 'submodule' THEN '160000' ELSE '100644' END AS mode, CASE entry_kind WHEN 'submodule' THEN 'commit' ELSE 'blob' END AS type,
           concat(md5(path), substr(md5(path), 1, 8)) AS object_id, CASE WHEN entry_kind <> 'submodule' THEN size END AS size
    FROM (SELECT repository, path, entry_kind, size FROM ({artifacts}) x) a CROSS JOIN (VALUES ('first'), ('second')) AS k(c)""".replace("{artifacts}", BINDINGS["artifacts"])


def _read(spark, sf_dir):
    folder = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    trees.write_dumps(relation(spark, sf_dir, "tree_records"), folder)
    return trees.read_trees(spark, folder)


def tree_entries(spark, sf_dir):
    return _read(spark, sf_dir)[0].select("repository", "commit", "path", "kind", "object_id", "size")


def refused_trees(spark, sf_dir):
    return _read(spark, sf_dir)[1]


def contract_identities(spark, sf_dir):
    """Keys of names with white space of several kinds, composed and decomposed letters, and some that are none."""
    k = C("p_partkey") % 6
    name = F.when(k == 0, F.concat(F.lit("\u3000 "), "p_name", F.lit("\t"))).when(k == 1, F.concat(F.lit("cafe\u0301/"), "p_brand")).when(k == 2, F.concat(F.lit("caf\u00e9/"), "p_brand", F.lit("\ufeff"))).when(k == 3, F.lit(" \u2003"))
    name = name.when(k == 4, F.repeat(F.lit("n"), (C("p_partkey") % 4 + 510).cast("int"))).otherwise(C("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", identity.contract_key("Npm", C("p_brand"), name).alias("canonical_key"))


def canonical_records(spark, sf_dir):
    """Three batches of records, the second played twice: new ones, ones that are there, and ones with other contents."""
    o = table(spark, sf_dir, "orders").groupBy(C("o_orderkey").alias("id")).agg(F.min("o_totalprice").alias("price"))
    record = lambda rows, text: rows.select("id", F.md5(F.concat(F.lit(text), C("id").cast("string"))).alias("hash"), C("price"))
    batches = [
        record(o.where("id % 3 = 0"), "a"), record(o.where("id % 3 = 1 or id % 6 = 0"), "a").unionByName(record(o.where("id % 9 = 0"), "b")), record(o, "a").unionByName(record(o.where("id % 15 = 2"), "c")),
    ]
    sink = LedgerSink(spark, f"{shared_dir(spark)}/records-{uuid.uuid4().hex}", "id long, hash string, price double", ["id"], "hash")
    for number in (0, 1, 1, 2):
        sink.write(batches[number], number)
    return sink.batches().select("batch", "appended", "conflicts").unionByName(sink.records().agg(F.lit(-1).cast("long").alias("batch"), F.count("*").alias("appended"), F.countDistinct("id").alias("conflicts")))


def typescript_modules(spark, sf_dir):
    """Imports of files among the documents, relative and by the aliases of two configurations."""
    k = C("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"))
    imports = table(spark, sf_dir, "part").select(
        k.alias("import_id"), F.when(k % 4 == 0, "src/app/x.ts").when(k % 4 == 1, "lib/y.ts").otherwise("src/x.ts").alias("path"),
        F.when(k % 4 == 0, F.concat(F.lit("../"), name, F.lit(".js"))).when(k % 4 == 1, F.concat(F.lit("@src/"), name)).when(k % 4 == 2, F.concat(F.lit("v!"), name, F.lit("!v"))).otherwise(F.concat(F.lit("./vendor/./"), name)).alias("specifier"),
    )
    texts = [("tsconfig.json", '{"compilerOptions": {"paths": {"@src/*": ["./missing/*", "src/*"], "v!*!v": ["dist/*"]}}}'), ("src/tsconfig.json", '{"compilerOptions": {"baseUrl": "..", "paths": {"v!*!v": ["src/vendor/*"]}}}')]
    texts = F.array(*(F.struct(F.lit(a).alias("path"), F.lit(b).alias("text")) for a, b in texts))
    configs = modules.parse_configs(spark.range(1).select(F.explode(texts).alias("t")).select("t.*"))
    return modules.resolve(imports, configs, relation(spark, sf_dir, "artifacts").select("path"))


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(5760), chr(8192), chr(8193), chr(8194), chr(8195), chr(8196), chr(8197), chr(8198), chr(8199), chr(8200), chr(8201), chr(8202), chr(8232), chr(8233), chr(8239), chr(8287), chr(12288), chr(65279))"
SQL = {
    "tree_entries": f"""{relation_sql("tree_records")}, bad AS (SELECT DISTINCT repository, "commit" FROM tree_records WHERE contains(path, '//'))
        SELECT repository, "commit", path, CASE mode WHEN '160000' THEN 'submodule' WHEN '120000' THEN 'symlink' ELSE 'blob' END AS kind, object_id, size FROM tree_records WHERE (repository, "commit") NOT IN (SELECT (repository, "commit") FROM bad)""",
    "refused_trees": f"""{relation_sql("tree_records")} SELECT repository, "commit", count(*) AS malformed FROM tree_records WHERE contains(path, '//') GROUP BY 1, 2""",
    "contract_identities": f"""WITH n AS (SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN concat(chr(12288), ' ', p_name, chr(9)) WHEN 1 THEN concat('cafe', chr(769), '/', p_brand) WHEN 2 THEN concat('caf', chr(233), '/', p_brand, chr(65279)) WHEN 3 THEN concat(' ', chr(8195)) WHEN 4 THEN repeat('n', p_partkey % 4 + 510) ELSE p_type END AS name FROM part),
        t AS (SELECT p_partkey, p_brand, trim(nfc_normalize(name), {_BLANKS}) AS name FROM n) SELECT p_partkey, CASE WHEN length(name) BETWEEN 1 AND 512 THEN concat('npm:', url_encode(p_brand), '#', url_encode(name)) END AS canonical_key FROM t""",
    "typescript_modules": f"""{relation_sql("artifacts")}, i AS (SELECT p_partkey AS import_id, CASE p_partkey % 4 WHEN 0 THEN [concat('src/f', p_partkey, '.js')] WHEN 1 THEN [concat('missing/f', p_partkey), concat('src/f', p_partkey)] WHEN 2 THEN [concat('src/vendor/f', p_partkey), concat('dist/f', p_partkey)] ELSE [concat('src/vendor/f', p_partkey)] END AS bases FROM part),
        b AS (SELECT import_id, unnest(bases) AS base, unnest(range(len(bases))) AS place FROM i), c AS (SELECT import_id, place, base, regexp_replace(base, '\\.(mjs|cjs|js|jsx)$', '') AS bare FROM b),
        t AS (SELECT import_id, place, unnest([base, bare, concat(bare, '.ts'), concat(bare, '.tsx'), concat(bare, '.mts'), concat(bare, '.cts'), concat(bare, '.d.ts'), concat(bare, '.js'), concat(bare, '.jsx'), concat(bare, '.mjs'), concat(bare, '.cjs'), concat(bare, '/index.ts'), concat(bare, '/index.tsx')]) AS path, unnest(range(13)) AS nth FROM c)
        SELECT import_id, arg_min(path, place * 100 + nth) AS path FROM t WHERE path IN (SELECT path FROM artifacts) GROUP BY import_id""",
    "canonical_records": """WITH o AS (SELECT DISTINCT o_orderkey AS id FROM orders), b(batch, id, h) AS (SELECT 0, id, 'a' FROM o WHERE id % 3 = 0 UNION ALL SELECT 1, id, 'a' FROM o WHERE id % 3 = 1 OR id % 6 = 0 UNION ALL SELECT 1, id, 'b' FROM o WHERE id % 9 = 0 UNION ALL SELECT 2, id, 'a' FROM o UNION ALL SELECT 2, id, 'c' FROM o WHERE id % 15 = 2),
        g AS (SELECT batch, id, count(DISTINCT h) AS kinds, min(h) AS h, count(*) AS n FROM b GROUP BY 1, 2), ok AS (SELECT id, min(batch) AS batch, arg_min(h, batch) AS h FROM g WHERE kinds = 1 GROUP BY id),
        s AS (SELECT g.batch, count(*) FILTER (ok.batch = g.batch) AS appended, CAST(coalesce(sum(g.n) FILTER (g.kinds > 1 OR ok.batch < g.batch AND ok.h <> g.h), 0) AS BIGINT) AS conflicts FROM g LEFT JOIN ok USING (id) GROUP BY g.batch)
        SELECT * FROM s UNION ALL SELECT -1, (SELECT count(*) FROM ok), (SELECT count(*) FROM ok)""",
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n in SQL and callable(f)}
