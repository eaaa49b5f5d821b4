"""The Merkle manifest against a plain recursive build, and odd rows."""

import hashlib
import zlib

from strideframe.llm import merkle_manifest
from strideframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join(code(v) for v in (doc_id, source, lang, n_chars, text)))


def build(nodes):
    """Levels of one tree, bottom first; a lone node is its own top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        run = pos // 8 * 8
        out.append(("".join(level[run:pos]), "".join(level[pos + 1:run + 8])))
        pos //= 8
    return out


def brute(rows, touched):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    by_group = {g: sorted([r for r in rows if r[2] == g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for g in groups}
    trees = {g: build([leaf(*r) for r in by_group[g]]) for g in groups}
    upper = build([trees[g][-1][0] for g in groups])
    root = upper[-1][0]
    out = {}
    for gi, g in enumerate(groups):
        for pos, r in enumerate(by_group[g]):
            path = siblings(trees[g], pos) + siblings(upper, gi)
            new = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                new = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            acc = leaf(*new)
            for left, right in path:
                acc = h(left + acc + right)
            out.setdefault(r[0], []).append((leaf(*r), trees[g][-1][0], root, h("".join(a + b for a, b in path)), acc, acc == root))
    return out


def test_manifest_equals_a_plain_build(spark, tmp_path):
    rows = [(i, f"Text Number {i} ÄÖ {'x' * (i % 5)}", ["en", "de", None, "fr"][i % 4] if i < 90 else "en", None if i % 7 == 0 else "web", i % 13)
            for i in range(1, 140)]
    rows += [(5000, "Lone", "zz", "s", 4), (None, "No Id", "en", "s", 5), (None, None, None, None, None), (3, rows[2][1], rows[2][2], rows[2][3], rows[2][4])]
    target = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, DOCS).withColumn("row", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).write.parquet(str(target))
    got = {}
    for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]))
    want = brute(rows, None)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert any(not v[-1] for vs in got.values() for v in vs) and any(v[-1] for vs in got.values() for v in vs)


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(7, "A", "en", "s", 1)], DOCS)
    (r,) = merkle_manifest.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["refolded"] == leaf(7, "A", "en", "s", 1) and r["proof_sha256"] == h("")
    assert merkle_manifest.manifest(one.where("false")).count() == 0


def test_numbering_spreads_a_hot_group(spark):
    frame = spark.range(0, 3000).selectExpr("id % 1000 as k", "case when id < 2000 then 'hot' else cast(id % 3 as string) end as g")
    got = merkle_manifest.numbered(frame, "g", [__import__("pyspark.sql.functions", fromlist=["col"]).col("k")]).collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r["_pos"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [k for _, k in mine] == sorted(k for _, k in mine)
        assert {r["_size"] for r in got if r["g"] == g} == {len(mine)}


def test_places_and_offsets_come_from_the_same_ranges(spark):
    """Rows with a wide column: ranges made twice are merged by other sizes where only the counts are read."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
                "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "40"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame = spark.range(0, 6000, 1, 5).selectExpr("6000 - id as k", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'b' end as g",
                                                      "sha2(cast(id as string), 512) as wide")
        got = merkle_manifest.numbered(frame, "g", [__import__("pyspark.sql.functions", fromlist=["col"]).col("k")]).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 6000
    for g in (None, "b", "hot"):
        mine = sorted((r["_pos"], r["k"]) for r in got if r["g"] == g)
        assert [p for p, _ in mine] == list(range(2000)) and [k for _, k in mine] == sorted(k for _, k in mine)
