import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from inspectra.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _near string, leaf string, pos int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(part(row[c]) for c in FIELDS))


def climb(nodes):
    """All levels of a tree, 8 nodes a run."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(tree, at):
    out = []
    for low in tree[:-1]:
        run = at - at % 8
        out.append((at - run, [x for i, x in enumerate(low[run:run + 8], run) if i != at]))
        at //= 8
    return out


def brute(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([leaf_of(r) for r in sorted(groups[g], key=lambda r: (first(r["doc_id"]), leaf_of(r)))]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for number, g in enumerate(order):
        for at, row in enumerate(sorted(groups[g], key=lambda r: (first(r["doc_id"]), leaf_of(r)))):
            path = path_of(trees[g], at) + path_of(top, number)
            node = leaf = leaf_of(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                node = leaf_of({**row, "text": "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row["text"])})
            for slot, sides in path:
                node = H(*sides[:slot], node, *sides[slot:])
            proof = H(*(s for _, sides in path for s in sides))
            out.append((row["doc_id"], leaf, trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def documents():
    rows = []
    for i in range(700):
        lang = ["en", "fr", None, "", "Ünï"][min(i % 7, 4)] if i % 50 else f"rare{i}"
        text = None if i % 31 == 0 else "" if i % 37 == 0 else f"Some Text {i} ÄÖ\x00x"
        rows.append((i if i % 41 else None, text, lang, None if i % 5 == 0 else "web", i if i % 3 else None, "n", "l", i))
    return rows + rows[100:103] + [(1 << 60, "A" * 300_000, "en", "web", 1, "n", "l", 1), ((1 << 60) + 1, "b", "en", "web", 1, "n", "l", 1)]


@pytest.mark.parametrize("height", [1, 4])
def test_equals_brute_force(spark, scratch, tmpdir_path, monkeypatch, height):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmpdir_path}/documents.parquet")
    whole = merkle.manifest
    monkeypatch.setattr(queries.merkle, "manifest", lambda leaves, s: whole(leaves, s, height=height))
    got = queries.op13_merkle_manifest(spark, tmpdir_path).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((tuple(r) for r in got), key=str) == brute([dict(zip(names, r)) for r in rows])
    # an upper-case text under test is the only thing that fails
    assert any(not r["verified"] for r in got) and sum(r["verified"] for r in got) > len(rows) / 2


def test_proofs_fold_to_the_root_and_nothing_else_does(spark, scratch):
    df = spark.range(300).select(F.lit("g").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.manifest(df.withColumn("test", F.col("leaf")), scratch, height=1).collect()
    assert len(got) == 300 and len({r["root"] for r in got}) == 1 and all(r["verified"] for r in got)
    for r in got[::17]:
        assert merkle.fold(r["leaf"], r["slots"], r["proof"]) == r["root"] != merkle.fold(H("x"), r["slots"], r["proof"])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, scratch, n):
    df = spark.range(n).select(F.lit(None).cast("string").alias("grp"), F.col("id").alias("key"), F.lit("ab").alias("leaf"), F.lit("ab").alias("test"))
    got = merkle.manifest(df, scratch).collect()
    want = "ab" if n == 1 else H("ab", "ab")
    assert len(got) == n and all(r["root"] == r["subroot"] == want and r["verified"] for r in got)


def test_every_leaf_a_group(spark, scratch):
    df = spark.range(100).select(F.format_string("%03d", "id").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.manifest(df.withColumn("test", F.col("leaf")), scratch, height=1).collect()
    root = climb([r["leaf"] for r in sorted(got, key=lambda r: r["key"])])[-1][0]
    assert all(r["subroot"] == r["leaf"] and r["root"] == root and r["verified"] for r in got)
