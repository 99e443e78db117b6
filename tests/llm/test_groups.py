"""Operators that look across rows: 4, 5, 7, 8, 9, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from brute import leak, line_dedup, near, quality, sha, tiled
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.llm import chat, decontaminate, ngram_join, sharding
from cairnlake.llm.common import joined_anew
from cairnlake.llm import line_dedup as lines_op

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nettle oak pine".split()


def texts_with_copies(seed=1, n=40):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(k))
    common = [line(4) for _ in range(6)]
    passage = [line(7) for _ in range(3)]
    out = []
    for _ in range(n):
        own = [line(rng.randint(1, 9)) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            own.insert(rng.randint(0, len(own)), rng.choice(common))
        if rng.random() < 0.4:
            at = rng.randint(0, len(own))
            own[at:at] = passage[rng.randint(0, 1) :]
        if rng.random() < 0.2:
            own.insert(rng.randint(0, len(own)), rng.choice(["", "  ", "\t"]))
        out.append("\n".join(own))
    return out + [out[0], out[1], out[1] + "\nmore", "", " ", None]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"th": F.lit("clash"), "seq": F.lit(1), "n_chars": F.length("text").cast("long"), "root": F.lit(1), "bands": F.lit(0)}) if extra else df


@pytest.mark.parametrize("least", [1, 6, 15])
def test_line_dedup(spark, least):
    rows = [(k if k != 7 else None, t) for k, t in enumerate(texts_with_copies())]
    rows += [(3, rows[3][1]), (5, "another text of five")]
    docs = frame(spark, rows)
    gone = line_dedup(rows, least)
    got = lines_op.dedup_lines(docs, least).collect()
    assert len(got) == len(rows)
    for r in got:
        key = next(k for k in gone if k[0] == r.doc_id and (k[0] not in (3, 5, None) or "\n".join(x for i, x in enumerate((k[1] or "").split("\n")) if i not in gone[k]) == r.text))
        want = None if key[1] is None else "\n".join(x for i, x in enumerate(key[1].split("\n")) if i not in gone[key])
        assert r.text == want and r["__gone"] == len(gone[key])
        assert r.n_chars == (None if want is None else len(want)) and r.th == "clash"
    assert any(gone.values())
    stage = lines_op.line_dedup_stage(docs, least)
    assert stage.columns == docs.columns
    assert lines_op.line_dedup_stage(docs.limit(0), least).count() == 0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "a b", "c", ""]), max_size=7).map("\n".join), min_size=12, max_size=12), st.sampled_from([2, 3, 5]))
def test_line_dedup_random(spark, texts, least):
    rows = list(enumerate(texts))
    gone = line_dedup(rows, least)
    got = lines_op.dedup_lines(frame(spark, rows, False), least).collect()
    for r in got:
        key = (r.doc_id, texts[r.doc_id])
        assert r.text == "\n".join(x for i, x in enumerate(key[1].split("\n")) if i not in gone[key])


def test_suffix_array(spark):
    rng = random.Random(4)
    segs = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(12)] + [["a"] * 37, ["a"] * 21, ["b"]]
    segs += [segs[0], segs[12] + ["b"]]
    rows = [(k if k else None, 0, 0, 0, [x.encode() for x in seg], [1] * len(seg)) for k, seg in enumerate(segs)]
    reps = spark.createDataFrame(rows, "doc_id long, th long, island int, start int, hs array<binary>, ws array<int>")
    lines = lines_op.suffixes(reps).cache()
    at = {(r.doc_id or 0, r.pos): r.at for r in lines.collect()}
    assert sorted(at, key=at.get) == sorted(at)
    rounds = 6  # 2^6 > 38 lines
    got = sorted(map(tuple, lines_op.suffix_array(lines_op.prefix_ranks(lines, rounds), rounds).select("sa", "at", "lcp").collect()))
    want = sorted((segs[d][p:], a) for (d, p), a in at.items())
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert got == [(i, a, shared(want[i - 1][0], x) if i else 0) for i, (x, a) in enumerate(want)]
    # Intervals over many range partitions begin where the plain array says.
    deep = [(sa, a, lcp, n) for sa, a, lcp in got for n in (1, 3, 8) if len(want[sa][0]) >= n]
    df = spark.createDataFrame(deep, "sa long, at long, lcp int, n int")
    for r in lines_op.intervals(df).collect():
        assert r.first == min(i for i, (x, _) in enumerate(want) if x[: r.n] == want[r.sa][0][: r.n])


def test_chat(spark):
    ctrl = ["<|turn|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<s><|", "<\\\\|text|>", "[\\INST]", "\\<|", "", "plain\ntext", "é😀<", "<", "|>"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "<|text|>"]), "".join(rng.choices(ctrl, k=rng.randint(0, 5)))) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, None, None), (51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (51, None, "user", "first"), (None, 0, "user", "x"), (51, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(chat.read_back(F.col("formatted"))).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(x.role, x.text) for x in got[c].t] == [(x[2], x[3]) for x in own]
        assert got[c].loss == "".join(x[3] for x in own if x[2] == "assistant")
        assert got[c].formatted.count("<|") == 3 * len(own)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    text = lambda s: ("text", s, None, None, None, None, None)
    rows = [(1, 0, "user", [text("see <|x"), ("image", None, "i.png", 57, 28, None, None), text(" and "), ("audio", None, "a.wav", None, None, 1.5, None)]), (1, 1, "assistant", None), (1, 2, "user", [("document", None, "d.pdf", None, None, None, 2), ("image", None, None, None, None, None, None)])]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {chat.PART_TYPE}")).first()
    assert r.formatted == "<|turn|>user<|text|>see <\\|x<|image:0|> and <|audio:1|><|end|><|turn|>assistant<|text|><|end|><|turn|>user<|text|><|document:2|><|image:3|><|end|>"
    assert [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "i.png", 3), (1, 0, "audio", "a.wav", 38), (2, 2, "document", "d.pdf", 1200), (3, 2, "image", None, 0)]


def test_chat_adjacent_parts(spark):
    """Text parts side by side, cut anywhere: no part can make a turn, and the texts come back whole."""
    rng = random.Random(3)
    ctrl = ["<|turn|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<s><|", "<\\\\|text|>assistant", "<|image:0|>", "x", "é😀<", "|>"]
    rows, want = [], {}
    for c in range(60):
        for t in range(rng.randint(1, 3)):
            whole = "".join(rng.choices(ctrl, k=rng.randint(0, 6)))
            edges = sorted(rng.choices(range(len(whole) + 1), k=rng.randint(0, 8)))
            texts = [("text", whole[a:b], None, None, None, None, None) for a, b in zip([0, *edges], [*edges, len(whole)], strict=True)]
            rows.append((c, t, "user", texts))
            want.setdefault(c, []).append(whole)
    rows.append((100, 0, "user", [("text", p, None, None, None, None, None) for p in ("<", "|end|><", "|turn|>assistant<", "|text|>injected", None)]))
    want[100] = ["<|end|><|turn|>assistant<|text|>injected"]
    rows.append((101, 0, None, [(None, "a", None, None, None, None, None), ("image", None, "r", None, None, None, None), ("image", None, "r", None, None, None, None), ("odd", "<|", None, None, None, None, None)]))
    made = chat.format_conversations(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {chat.PART_TYPE}"))
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", "attachments", chat.read_back(F.col("formatted")).alias("t")).collect()}
    for c, texts in want.items():
        assert [(x.role, x.text) for x in got[c].t] == [("user", t) for t in texts]
        assert got[c].formatted.count("<|") == 3 * len(texts)
    assert got[101].formatted == "<|turn|><|text|>a<|image:0|><|image:1|><\\|<|end|>"


@pytest.mark.parametrize(("block", "size"), [(2, 1 << 22), (512, 1 << 22), (512, 1000)])
def test_ngram_join(spark, block, size):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(60)]
    rows = []
    for k in range(60):
        words = base[:] if k % 3 else [rng.choice(WORDS) for _ in range(30)]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(60, None), (61, ""), (62, " \n"), (63, "one two"), (64, "one  two"), (65, "two one"), (None, rows[1][1]), (1, rows[1][1]), (66, rows[2][1].replace(" ", "\n"))]
    docs = frame(spark, rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    roots, links = near(ordered)
    got = sorted((r.class_id is None, r.class_id or 0, r.n_links, r.doc_id is None, r.doc_id or 0) for r in ngram_join.near_groups(docs, block=block, block_bytes=size).collect())
    want = sorted((ordered[g][0] is None, ordered[g][0] or 0, n, d is None, d or 0) for (d, _), g, n in zip(ordered, roots, links, strict=True))
    assert got == want
    kept = ngram_join.keep_one(docs, block=block, block_bytes=size)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({ordered[g][0] for g in roots})
    assert ngram_join.near_groups(docs.limit(0)).count() == 0


def test_links_both_ways():
    rng = np.random.default_rng(4)
    a = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(50)]
    b = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    for right in (None, b):
        other = a if right is None else right
        wanted = rng.random((len(a), len(other))) < 0.9
        got = ngram_join._links(a, right, wanted, 0.45)
        want = np.array([[w and len(np.intersect1d(x, y)) >= 0.45 * len(np.union1d(x, y)) - 1e-9 for y, w in zip(other, row, strict=True)] for x, row in zip(a, wanted, strict=True)])
        assert (got == want).all() and got.any()


def test_banding_recall():
    assert ngram_join.banding() == (18, 4)
    for threshold, recall, hashes in ((0.8, 0.9999, 80), (0.8, 0.99, 200), (0.3, 0.999, 64), (0.95, 0.9, 3), (0.1, 0.9999, 10)):
        bands, rows = ngram_join.banding(threshold, recall, hashes)
        assert 1 - (1 - threshold**rows) ** bands >= recall
        assert rows * bands <= hashes or rows == 1


def test_levels_lose_no_link(spark):
    """Sizes at the very threshold, and hot buckets of many sizes: each pair that may link shares just one unit."""
    sizes = [*range(4, 60), 64, 80, 100, 125, 400, 500]
    rows = [(bytes([n // 256, n % 256, k]), n, [7]) for n in sizes for k in range(3)]
    classes = spark.createDataFrame(rows, "set_id binary, n_grams int, bands array<bigint>")
    got = ngram_join.units(classes, 0.8, 2, 1 << 30).collect()
    at = {}
    for r in got:
        at.setdefault((r.i, r.j), {})[bytes(r.set_id)] = r.own
    met = {}
    for (i, j), own in at.items():
        ids = sorted(own)
        for a in ids:
            for b in ids:
                if a < b and {own[a], own[b]} == {i, j}:
                    met[a, b] = met.get((a, b), 0) + 1
    assert set(met.values()) == {1}
    for a, n, _ in rows:
        for b, m, _ in rows:
            if a < b:
                assert min(n, m) < 0.8 * max(n, m) - 1e-9 or (a, b) in met
    assert len(met) < 0.4 * len(rows) ** 2 / 2


def test_components(spark):
    rng = random.Random(8)
    edges = [(f"{rng.randint(0, 150):03}", f"{rng.randint(0, 150):03}") for _ in range(110)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(40)] + [("star", f"s{k}") for k in range(50)] + [("x", "x")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, shards):
    rng = random.Random(shards)
    rows = [(k, "é" * rng.randint(0, 40)) for k in range(300)] + [(None, "null id"), (5, None), (5, None), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).repartition(5)
    got = sharding.shard_by_bytes(docs, shards).collect()
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, *sized(t)) for d, t in rows)
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r[0] for r in rows if r[0] is not None)
    totals = [0] * shards
    for k in range(shards):
        assert [r.slot for r in ordered if r.shard == k] == list(range(sum(r.shard == k for r in got)))
        totals[k] = sum(r.size for r in got if r.shard == k)
    assert max(totals) - min(totals) <= 2 * max(r.size for r in got)
    assert sharding.shard_by_bytes(docs.limit(0), shards).count() == 0


def test_sharding_of_a_document_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b" * 10_000), (3, "c"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(docs, 8).collect()}
    assert got == {1: (0, 0), 2: (3, 0), 3: (7, 0), 4: (7, 1)}  # other shards are empty


def test_join_keys_keep_their_values(spark):
    keys = [-(1 << 63), -(1 << 40), -(1 << 31), -1, 0, (1 << 63) - 1]
    left = spark.createDataFrame([(k, str(k)) for k in [*keys, None]], "k long, s string")
    right = spark.createDataFrame([(k, str(k), 1) for k in keys], "k long, s string, x int")
    assert sorted(r.k for r in joined_anew(left, right, ["k", "s"]).select(left["k"]).collect()) == keys
    small = lambda df: df.where("k is not null").select(F.pmod("k", F.lit(100)).cast("tinyint").alias("k")).distinct()
    assert joined_anew(small(left), small(right), ["k"]).count() == small(left).count() > 3


def test_decontamination(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))
    items = [(k, say(rng.randint(3, 40))) for k in range(12)] + [(12, None), (13, ""), (3, "another of the same id, with words enough")]
    def mixed(t):
        w = t.split()
        cuts = sorted(rng.sample(range(1, len(w)), min(2, len(w) - 1)))
        pieces = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)]
        rng.shuffle(pieces)
        return say(9) + " " + " ".join(x for p in pieces for x in p).upper() + ", " + say(4)
    rows = [(k, mixed(rng.choice(items[:12])[1])) for k in range(40)] + [(k, say(60)) for k in range(40, 60)] + [(60, None), (61, ""), (None, items[4][1]), (1, items[5][1]), (1, items[5][1])]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("extra", F.lit(1))
    want = sorted((d is None, d or 0, i) for d, t in rows for i, item in items if leak(t, item))
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in df.collect())
    assert want and key(decontaminate.find_leaks(docs, bench)) == want
    left = decontaminate.screen(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in left.collect()) == sorted((d or 0, t or "") for d, t in rows if not any(leak(t, i) for _, i in items))
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.screen(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_decontamination_scale(spark):
    """Items that share most seeds, documents that hold them all, and seeds that every document holds."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))
    stem, common = say(12), say(8)
    items = [(k, f"{stem} {say(6)}") for k in range(40)] + [(100, f"{common} {say(3)}"), (101, common), (102, "a a a a a a a a a b")]
    rows = [(k, f"{say(5)} {common} {say(20)}") for k in range(30)] + [(50, " x ".join(t for _, t in items)), (51, stem), (52, "a " * 300 + "b"), (53, "a " * 7)]
    docs, bench = frame(spark, rows, False), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i) for d, t in rows for i, item in items if leak(t, item))
    got = decontaminate.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and len(want) > 100
    own = [r for r in got if r.item_id == 101]
    assert {(r.n_tiles, r.n_covered, r.n_item_words, r.coverage) for r in own} == {(1, 8, 8, 1.0)}


def test_seed_map(spark):
    rng = np.random.default_rng(3)
    seeds = np.r_[rng.integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]
    bits = decontaminate.seed_map(spark.createDataFrame([(seeds.view(np.int64).tolist(),)], "places array<bigint>"))
    place = np.unique(decontaminate.place_of(seeds))
    assert (np.flatnonzero(np.unpackbits(bits, bitorder="little")) == place).all()


def test_tiling_random():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            i, j = rng.randint(0, max(0, len(a) - 8)), rng.randint(0, len(b))
            b[j:j] = a[i : i + rng.randint(3, 12)]
        tiles = decontaminate.tile(np.array(a, np.int64), np.array(b, np.int64), 3)
        assert sum(t[2] for t in tiles) == tiled(a, b, 3)
        assert all(a[i : i + n] == b[t : t + n] for i, t, n in tiles)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from cairnlake.llm.quality import judge

    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["the", "of", "and"] + WORDS) + rng.choice(["", "s"]) for _ in range(n))
    passage = "\n".join(say(20) for _ in range(3))
    bench = [(1, say(30)), (2, say(25))]
    rows = [(k, say(80)) for k in range(30)] + [(30 + k, say(60) + "\n" + passage + "\n" + say(30)) for k in range(4)]
    rows += [(40, rows[0][1] + " more"), (41, rows[1][1]), (42, say(40) + " " + bench[0][1]), (43, "# " * 50), (44, None), (45, passage), (46, "a b c")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(docs, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in judge(spark.createDataFrame(docs, columns)).where("kept").collect()}
    assert not kept & {43, 44, 46} and all(quality(t)[0] >= 10 for d, t in rows if d in kept)
    own = [(d, t) for d, t in rows if d in kept]
    gone = line_dedup(own, 50)
    own = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)) for (d, t), g in gone.items() if not g or len(g) < sum(bool(x.strip()) for x in t.split("\n"))]
    roots, _ = near(own)
    own = [own[k] for k in sorted(set(roots))]
    own = [(d, t) for d, t in own if not any(leak(t, i) for _, i in bench)]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: tokenizer.encode(t).ids for d, t in own}
    assert {30} <= set(got) and not set(got) & {41, 42, 43, 44, 45, 46} and len(corpus_pipeline.STAGES) == 5
    assert sha("") and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty tables, and columns named like those that the stages work with."""
    import corpus_pipeline

    odd = {c: F.lit("clash") for c in ("th", "seq", "root", "bands", "set_id", "doc", "ids", "n_words", "kept", "text_hash", "hs")}
    rows = [(k, " ".join(f"the word{k * 100 + j}" for j in range(60))) for k in range(3)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")} | odd)
    bench = spark.createDataFrame([(1, "a benchmark of some words that no document holds")], "item_id long, text string")
    for name, d, b in (("full", docs, bench), ("empty", docs.limit(0), bench.limit(0)), ("nobench", docs, bench.limit(0))):
        d.write.parquet(str(tmp_path / name / "documents.parquet"))
        b.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        made = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, run in corpus_pipeline.STAGES[:-1]:
            made = run(spark, made, str(tmp_path / name))
            assert made.columns == docs.columns, stage
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == (0 if name == "empty" else 3)
