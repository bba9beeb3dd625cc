"""Fuzzy line dedup against brute force over all pairs of lines."""

import itertools
import random

import numpy as np
import pytest

from inspectra.llm import line_dedup as ld
from inspectra.session import setting

from .conftest import union_find

SCHEMA = "doc_id long, text string"


def brute(rows, min_chars=ld.MIN_CHARS, k=ld.SHINGLE_CHARS):
    places = sorted({(i, n, x.strip(" \t\x0b\x0c\r")) for i, t in rows if i is not None and t is not None
                     for n, x in enumerate(t.split("\n")) if len(x.strip(" \t\x0b\x0c\r")) >= min_chars})
    sets = {t: ld.shingles(t, k) for _, _, t in places}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = union_find(links, list(sets))
    first = {}
    for i, n, t in places:
        first.setdefault(group[t], (i, n))
    return sorted((i, n, *first[group[t]], (i, n) == first[group[t]]) for i, n, t in places)


def corpus(seed=1, docs=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 60, 200]))) for _ in range(120)]

    def changed(line):
        w = line.split(" ")
        for _ in range(rng.randrange(1, max(2, len(w) // 12))):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    out = [(i, "\n".join(rng.choice([str, str, changed, lambda x: f"  {x}\t\r"])(rng.choice(lines)) for _ in range(rng.randrange(12))))
           for i in range(docs)]
    return out + [(900, None), (901, ""), (902, "short\n\n \nshort"), (903, "é" * 30 + "\n" + "é" * 31), (904, "x" * 200_000 + "\n" + "x" * 100_000)]


def run(spark, scratch, data, schema=SCHEMA, **options):
    out = ld.line_classes(spark.createDataFrame(data, schema).repartition(5), scratch, **options)
    return sorted(tuple(r) for r in out.select("doc_id", "line", "first_doc", "first_line", "kept").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, scratch, seed):
    rows = corpus(seed)
    assert run(spark, scratch, rows) == brute(rows)


@pytest.mark.parametrize("block", [1024, 4])
def test_mixed_buckets_are_compared_exactly(spark, scratch, monkeypatch, block):
    """One row a band puts dissimilar lines into shared buckets; all links must still be found."""
    monkeypatch.setattr(ld, "BLOCK", block)
    rng = random.Random(9)
    chain = [list("abcdefghij" * 12)]
    for _ in range(40):  # neighbours are similar, the ends are not
        chain.append(list(chain[-1]))
        chain[-1][rng.randrange(120)] = rng.choice("KLMNOP")
    rows = [(i, "".join(t)) for i, t in enumerate(chain)]
    rng.shuffle(rows)
    rows += corpus(3, 15)[:15]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    monkeypatch.setattr(ld, "HOME_ROWS", 30)
    monkeypatch.setattr(ld, "PART_BANDS", 100)
    assert run(spark, scratch, rows, bands=48, rows=1) == brute(rows)


def test_band_hashes_are_those_of_each_line_alone():
    lines = ["a", "abcdefgh", "abcdefghi", "日本語テキスト" * 9, "x" * 500, "z y x w v u t s r q"]
    whole = ld.band_hashes(lines, 8, 12, 4)
    for i, t in enumerate(lines):
        assert (ld.band_hashes([t], 8, 12, 4)[0] == whole[i]).all()
    assert (ld.band_hashes(["x" * 9], 8, 12, 4) == ld.band_hashes(["x" * 900], 8, 12, 4)).all()


def test_recall_of_the_banding():
    """The shipped shingles and bands find pairs just above the threshold."""
    rng = np.random.default_rng(4)
    found = tried = 0
    for _ in range(400):
        a = "".join(rng.choice(list("abcdefghijklmnop"), 300))
        b = list(a)
        for p in rng.choice(300, 7, replace=False):
            b[p] = "Z"
        b = "".join(b)
        x, y = ld.shingles(a, ld.SHINGLE_CHARS), ld.shingles(b, ld.SHINGLE_CHARS)
        if 0.8 <= len(x & y) / len(x | y) <= 0.84:
            h = ld.band_hashes([a, b], ld.SHINGLE_CHARS, ld.BANDS, ld.ROWS)
            tried += 1
            found += bool((h[0] == h[1]).any())
    assert tried > 100 and found / tried > 0.99


def test_sketches_never_rule_out_similar_lines():
    rng = random.Random(2)
    lines = ["", "a", "aaaaaaaaaaaa", "abcab", "x" * 5000]
    for _ in range(300):
        base = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 400)))
        lines += [base, base[rng.randrange(3):], base + "q" * rng.randrange(4)]
    many, words = ld.sketches(lines, 5)
    ruled_out = 0
    for i, t in enumerate(lines):
        bound = ld.most_alike(many[i], words[i], many, words)
        for j in range(i, min(len(lines), i + 40)):
            x, y = ld.shingles(t, 5), ld.shingles(lines[j], 5)
            assert bound[j] >= len(x & y) / len(x | y) - 1e-12
            ruled_out += bound[j] < 0.8
    assert ruled_out > 5000  # and they do rule out many


def test_hot_line_nulls_repeats_clashes_empty(spark, scratch):
    hot = "this very common line stands in every third document"
    rows = [(i, f"{hot}\nown line number {i * 7919} of document {i * 104729}" if i % 3 else f"{i * 31} {'abcdefghijklmnop'[i % 16] * 40}{i}") for i in range(90)]
    assert run(spark, scratch, rows) == brute(rows)
    clash = [(1, hot, 5, "x"), (1, hot, 6, "y"), (None, hot, 7, None), (0, None, 8, "z"), (2, f" {hot} ", 9, "w")]
    got = run(spark, scratch, clash, "doc_id long, text string, line int, id string")
    assert got == [(1, 0, 1, 0, True), (1, 0, 1, 0, True), (2, 0, 1, 0, False)]
    assert run(spark, scratch, []) == []


def test_lines_are_dropped_from_the_documents(spark, scratch):
    a, b, c = "the first of the long lines here", "a second line that is long enough", "and a third line, long enough too"
    rows = [(1, f"{a}\nshort\n{b}", "s"), (2, f"{b}\n\n{c}\nshort", "s"), (3, f"{a}\n  \n{c}", "s"), (4, None, "s"), (5, "", "s"), (None, a, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    out = ld.drop_repeated_lines(docs, scratch)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{a}\nshort\n{b}", 2: f"\n{c}", 4: None, 5: "", None: a}
    longer = ld.drop_repeated_lines(docs, scratch, min_chars=20)
    assert {r.doc_id: r.text for r in longer.collect()} == {1: f"{a}\nshort\n{b}", 2: f"\n{c}\nshort", 4: None, 5: "", None: a}
    clash = docs.withColumns({"_gone": docs.text, "_doc": docs.doc_id, "class": docs.text, "kept": docs.line})
    got = ld.drop_repeated_lines(clash, scratch)
    assert got.columns == clash.columns and got.count() == out.count()


def test_bitmap_lets_every_wanted_id_pass(spark, monkeypatch):
    monkeypatch.setattr(ld, "FILTER_BITS", 1 << 10)
    ids = [0, 1, 63, 64, -1, -2**63, 2**63 - 1, 12345678901]
    bits = ld.id_bitmap(spark.createDataFrame([(i,) for i in ids], "want long"), "want")
    assert len(bits) == 16 and all(int(bits[(i & 1023) >> 6]) >> (i & 63) & 1 for i in ids)
    assert sum(int(b).bit_count() for b in bits) == len({i & 1023 for i in ids})


def test_short_lines_have_rows_and_repeats_go(spark, scratch, tmp_path):
    import corpus_pipeline as cp
    from inspectra.llm import queries
    rows = [(1, "Les.\nune ligne\n \nx"), (2, "日本語の文です。\n Les. "), (3, "x\n日本語の文です。\nown"), (4, "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).select("doc_id", "line", "first_doc", "first_line", "kept").collect()
    assert sorted(map(tuple, out)) == brute(rows, 1) and len(out) == 9
    left = cp.line_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id: r.text for r in left.collect()} == {1: rows[0][1], 2: "日本語の文です。", 3: "own"}


def test_one_edit_in_a_medium_line_is_found(spark, scratch):
    """One inner character from 49 characters on, one two-letter word from 58 (8-character shingles: 79 and 88)."""
    rng = random.Random(11)
    rows = []
    for n in range(49, 81):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        rows += [(len(rows), line), (len(rows) + 1, line[:n // 2] + "Z" + line[n // 2 + 1:])]
    for n in range(61, 81):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        rows += [(len(rows), f"{line[:n // 2 - 1]} of {line[n // 2 + 3:]}"), (len(rows) + 1, f"{line[:n // 2 - 1]} by {line[n // 2 + 3:]}")]
    assert run(spark, scratch, rows) == [(i, 0, i // 2 * 2, 0, i % 2 == 0) for i in range(len(rows))]


def test_bands_go_early_and_texts_are_sent_by_key_at_every_size(spark, scratch):
    rows = [(i, f"line number {i} of this text, which nobody else has at all\nthe same last line everywhere, in each of them") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ld.drop_repeated_lines(docs, scratch)
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    left = {f.getPath().getName().rsplit("-", 1)[0] for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)}
    assert {"classed", "firsts", "gone"} <= left and not left & {"signed", "places", "hits", "texts", "members"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sum(r.text.count("\n") for r in out.collect()) == 1


def test_shingle_sets_are_those_of_each_line():
    lines = ["", "abcd", "abcde", "aaaaaaaaaa", "abcab" * 40, "Ωμέγα και άλφα", "日本語テキスト", "abc\x00\x00", "abc\x00\x00\x00", "ab日cdefgh", "࿿" * 6, "က" * 6, "x" * 400]
    for k in (3, 5, 8):
        for t, own in zip(lines, ld.shingle_sets(lines, k)):
            whole = ld.shingles(t, k)
            assert (own is None) == (len(t) < k or any(ord(c) >> 64 // k for c in t))
            if own is not None:
                assert own.tolist() == sorted(sum(ord(c) << (k - 1 - i) * (64 // k) for i, c in enumerate(x)) for x in whole)
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 40)))
        b = a[rng.randrange(3):] + rng.choice(["", "c", "ab"]) + "abcde"
        x, y = ld.shingles(a, 5), ld.shingles(b, 5)
        assert ld.similar(*ld.shingle_sets([a, b], 5), 0.8) == ld.similar(x, y, 0.8) == (5 * len(x & y) >= 4 * len(x | y))


@pytest.mark.parametrize("options", [{}, {"bands": 48, "rows": 1}])
def test_lines_in_every_script_match_brute_force(spark, scratch, monkeypatch, options):
    """Sets are compared as numbers where all characters fit, else as strings; also a line of one kind with one of the other."""
    monkeypatch.setattr(ld, "REMEMBERED_SHINGLES", 300)
    rng = random.Random(6)
    rows = []
    for alphabet in ("abcdefgh ", "αβγδεζηθ ", "日本語文字列表 ", "🙂🙃😀😁😂 "):
        for n in (3, 4, 5, 60, 90, 140):
            line = "".join(rng.choice(alphabet) for _ in range(n))
            for c in "aλ日🙂":
                rows.append((len(rows), f"{line}\n{line[:n // 2]}{c}{line[n // 2 + 1:]}\n{line[1:]}{c}"))
    assert run(spark, scratch, rows, **options) == brute(rows)


def test_small_tables_are_written_in_few_files(spark, scratch):
    """A task that writes a file starts processes for it: the files go with the bands, not with the shuffle's partitions."""
    rows = [(i, f"line number {i // 2} of {i // 2 * 104729}, said twice") for i in range(400)]
    with setting(spark, "spark.sql.shuffle.partitions", "64"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        assert run(spark, scratch, rows) == brute(rows)
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch.root)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = {p.getPath().getName().rsplit("-", 1)[0]: sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(p.getPath())) for p in fs.listStatus(root)}
    most = max(spark.sparkContext.defaultParallelism, ld.FILES)
    assert 0 < files["firsts"] <= most and 0 < files["edges"] <= most
