import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnlake.functions import codec, identity
from cairnlake.operators import chunking, gc, index, packing, restore, snapshots, tree, verify
from cairnlake.operators.chunking import Params, cut_points, gear
from cairnlake.sources import files


def plain_cuts(data: bytes, p: Params) -> list[int]:
    g, out, s, n = [int(x) for x in gear()], [], 0, len(data)
    while s < n:
        limit = min(n - s, p.most)
        cut, h = s + limit, 0
        for i in range(s + p.least, s + limit) if limit > p.least else ():
            h = ((h << 1) + g[data[i]]) & (2**64 - 1)
            if h & (p.hard if i < s + min(p.average, limit) else p.easy) == 0:
                cut = i + 1
                break
        out.append(cut)
        s = cut
    return out


EASY = Params(8, 32, 128, 0x0000D90003030000, 0x0000000003030000)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([EASY, Params(1, 2, 3), Params(64, 256, 1024, EASY.hard, EASY.easy)]))
def test_cuts_equal_the_plain_loop(data, p):
    assert cut_points(data, p) == plain_cuts(data, p)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([EASY, Params(1, 2, 3), Params(64, 256, 1024, EASY.hard, EASY.easy)]), st.integers(1, 700))
def test_streamed_chunks_equal_those_of_the_whole(data, p, size):
    import io

    pieces = [*chunking.stream(io.BytesIO(data).read, p, size)]
    assert b"".join(pieces) == data and np.cumsum([len(x) for x in pieces]).tolist() == cut_points(data, p)


def test_streaming_holds_little():
    """200 MB go through in a fraction of that."""
    import tracemalloc

    left, block = [100], random.Random(1).randbytes(1 << 21)

    def read(n):
        left[0] -= 1
        return block if left[0] >= 0 else b""

    tracemalloc.start()
    total = sum(len(x) for x in chunking.stream(read))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 100 << 21 and peak < 100 << 20


def test_content_hash(spark):
    import hashlib

    rows = [(k, "x" if k == 1 else None, n, None if n == 3 else bytes([k or 0, n % 256]) * (n % 7)) for k in [1, 2, None] for n in range(2000)] + [(9, "x", 0, None)]
    got = {(r.k, r.s): r.file_hash for r in chunking.content_hash(spark.createDataFrame(random.Random(1).sample(rows[:4000], 4000) + rows[6000:], "k int, s string, n int, d binary"), ["k", "s"], "n", "d").collect()}
    want = {}
    for k, s, n, d in rows[:4000] + rows[6000:]:
        want.setdefault((k, s), hashlib.sha256()).update(d or b"")
    assert got == {k: h.hexdigest() for k, h in want.items()}
    assert chunking.content_hash(spark.createDataFrame([], "k int, n int, d binary"), ["k"], "n", "d").count() == 0


def test_no_local_checkpoints_on_a_cluster():
    from types import SimpleNamespace

    from cairnlake.operators.state import cut

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(SimpleNamespace(sparkSession=session))


def test_cuts_at_full_size():
    sizes = lambda d: np.diff([0, *cut_points(d)]).tolist()
    assert sizes(b"") == [] and sizes(b"x") == [1] and sizes(bytes(16384)) == [16384] and sizes(bytes(16385)) == [16385]
    assert sizes(bytes(600_000)) == [262144, 262144, 75712]
    data = random.Random(5).randbytes(1_500_000)
    assert sum(sizes(data)) == len(data) and all(16384 < x <= 262144 for x in sizes(data)[:-1])
    pieces = lambda d: {d[a:b] for a, b in zip([0, *cut_points(d)], cut_points(d), strict=False)}
    changed = data[:700_000] + b"!" + data[700_000:]
    assert len(pieces(changed) - pieces(data)) <= 3


def test_chunk_frames(spark):
    data = random.Random(2).randbytes(5000)
    rows = spark.createDataFrame([(1, data, "k"), (2, b"", "k"), (3, None, None), (4, b"abc", "k"), (1, data, "k")], "file_id int, content binary, seq_own string")
    got = chunking.chunk(rows, params=EASY).collect()
    assert {r.file_id for r in got} == {1, 4}
    one = sorted((r.seq, r.offset, bytes(r.data)) for r in got if r.file_id == 1)[::2]
    assert b"".join(x[2] for x in one) == data and [x[1] for x in one] == [0, *plain_cuts(data, EASY)[:-1]]
    assert chunking.chunk(rows.limit(0)).count() == 0


def test_pack_fold_over_partitions(spark):
    rng = random.Random(4)
    lengths = [rng.choice([1, 10, 500, 2000]) for _ in range(3000)]
    for target in (300, 5000, 10**9):
        want, pack, size, offsets = [], 0, 5, []
        for n in lengths:
            if size >= target:
                pack, size = pack + 1, 5
            offsets.append(size + 36)
            size += 36 + n
            want.append(pack)
        rows = spark.createDataFrame(list(enumerate(lengths)), "i int, length int").repartition(7)
        got = packing.assign(rows, ["i"], target=target).orderBy("i").collect()
        assert [r.pack_no for r in got] == want and [r.offset for r in got] == offsets
    assert packing.assign(rows.limit(0), ["i"]).count() == 0


def test_report_agrees_with_fold():
    rng = random.Random(6)
    for _ in range(200):
        n = np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 40))], np.int64)
        target = rng.randint(41, 300)
        upto, packs, left = packing.report(n, target)
        for size in {5, *[rng.randint(5, target - 1) for _ in range(5)]}:
            number, rest = packing.fold(n, target, size)
            k = int(np.searchsorted(upto, target - size))
            ended, after = (packs[k], left[k]) if k < len(upto) else (0, size + int((n + 36).sum()))
            assert after == rest and ended == number[-1] + (rest == 5)


def test_globs_and_names(spark):
    cases = [("src/a.pyc", "*.pyc", True), ("a/node_modules/x.js", "node_modules", True), ("docs/a/b.md", "docs/*.md", True), ("Docs/a", "docs/*", False), ("src/a.pyc", "?.pyc", True), ("x[1]", "x[[]1]", True), ("b", "[!a]", True), ("a+b", "a+b", True), ("aab", "a+b", False)]
    for path, glob, want in cases:
        assert spark.range(1).select(identity.excluded(F.lit(path), [glob])).first()[0] is want, (path, glob)
    names = {"": False, ".": False, "..": False, "a/b": False, "...": True, "é": True, None: False}
    rows = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.ok for r in rows.select("n", identity.legal_entry_name(F.col("n")).alias("ok")).collect()} == names
    blobs = {"packs/x": True, "/x": False, "a/../b": False, "": False, "a..b": True}
    rows = spark.createDataFrame([(k,) for k in blobs], "n string")
    assert {r.n: r.ok for r in rows.select("n", identity.legal_blob_name(F.col("n")).alias("ok")).collect()} == blobs
    with pytest.raises(Exception, match="not a 32-byte"):
        spark.range(1).select(identity.from_hex(F.lit("ab"))).collect()


def test_index(spark):
    rows = spark.createDataFrame([("a", 1, "p1", 5, 9), ("a", 3, "p3", 7, 9), ("b", 2, "p2", 1, 4), (None, 1, "p1", 0, 0)], "chunk_id string, batch long, pack_id string, offset long, length long")
    assert {(r.chunk_id, r.pack_id) for r in index.last_wins(rows, "batch").collect()} == {("a", "p3"), ("b", "p2"), (None, "p1")}
    base = index.clear(rows.drop("batch"))
    assert {(r.chunk_id, r.pack_id) for r in index.upsert(base, rows).collect()} == {("a", "p3"), ("b", "p2"), (None, "p1")}
    kept = index.remove(rows.drop("batch"), spark.createDataFrame([("a",)], "chunk_id string"))
    assert {r.chunk_id for r in kept.collect()} == {"b", None}
    new = spark.createDataFrame([("a", 1), ("c", 2), ("c", 1)], "chunk_id string, seq int")
    assert [(r.chunk_id, r.seq) for r in index.fresh(new, rows, ["seq"]).collect()] == [("c", 1)]
    assert {r.chunk_id for r in index.has(new, rows).collect()} == {"a"}


def test_index_of_nulls(spark):
    rows = spark.createDataFrame([("a", 5, "x"), ("a", 5, None), (None, 3, None), ("b", None, "x"), ("b", 2, "y")], "chunk_id string, length long, run string")
    got = {r.run: (r.chunks, r.unique_chunks, r.bytes, r.unique_bytes) for r in index.dedup_report(rows, "run").collect()}
    assert got == {"x": (2, 2, 5, 5), None: (2, 2, 8, 8), "y": (1, 1, 2, 2)}
    runs = index.running(rows, "run").orderBy("run").collect()
    assert [(r.run, r.new_chunks, r.new_bytes, r.stored_bytes) for r in runs] == [("x", 2, 7, 7), ("y", 0, 0, 7)]
    assert index.dedup_report(rows.limit(0), "run").count() == index.running(rows.limit(0), "run").count() == 0
    idx = spark.createDataFrame([("a", "p", 5, 9), (None, "p", 0, 1)], "chunk_id string, pack_id string, offset long, length long")
    probe = spark.createDataFrame([("a",), (None,), ("z",)], "chunk_id string")
    assert [r.chunk_id for r in index.has(probe, idx).collect()] == ["a"]
    assert {r.chunk_id for r in index.missing(probe, idx).collect()} == {None, "z"}
    assert {r.chunk_id: r.pack_id for r in index.locate(probe, idx).collect()} == {"a": "p", None: None, "z": None}
    assert [r.chunk_id for r in index.remove(idx, probe).collect()] == [None]
    blobs = spark.createDataFrame([("p", None)], "pack_id string, size long")
    assert verify.bad_geometry(idx, blobs).count() == 0 and verify.missing_packs(idx, blobs.limit(0)).first().chunks == 2
    assert {r.chunk_id for r in verify.missing_chunks(probe, idx).collect()} == {None, "z"}
    empty = verify.report(probe.limit(0), idx.limit(0), blobs.limit(0)).first()
    assert empty.ok and empty.chunks_indexed == 0


def test_snapshots(spark):
    rows = spark.createDataFrame([("aa11", 1.0), ("aa22", 3.0), ("bb33", 2.0)], "id string, created double")
    assert [r.id for r in snapshots.listed(rows).collect()] == ["aa11", "bb33", "aa22"]
    assert snapshots.resolve(rows, "latest") == "aa22" and snapshots.resolve(rows, "bb") == "bb33"
    refs = spark.createDataFrame([("aa",), ("aa1",), ("",), ("aa11",), ("aa111",), (None,), ("aa",)], "ref string")
    got = {r.ref: (r.n, r.status, r.id) for r in snapshots.matches(rows.unionAll(spark.createDataFrame([(None, 9.0)], rows.schema)), refs).collect()}
    assert got == {"aa": (2, "ambiguous", None), "aa1": (1, "ok", "aa11"), "": (3, "ambiguous", None), "aa11": (1, "ok", "aa11"), "aa111": (0, "not_found", None), None: (0, "not_found", None)}
    for ref in ("aa", "zz"):
        with pytest.raises(snapshots.SnapshotError):
            snapshots.resolve(rows, ref)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.resolve(rows.limit(0), "latest")


def test_gc_table(spark):
    packs = {"p1": (5, 0), "p2": (0, 5), "p3": (9, 1), "p4": (4, 1), "p7": (0, 2)}
    entries = [(f"{p}-{'live' if k < a else 'dead'}{k}", p, 0, 10) for p, (a, d) in packs.items() for k in range(a + d)]
    orphans = [("p5-live", "p5", 0, 10), ("p5-dead", "p5", 0, 10), ("p6-dead", "p6", 0, 10), ("p1-live0", "p6", 0, 10)]
    schema = "chunk_id string, pack_id string, offset long, length long"
    idx, lost = spark.createDataFrame(entries, schema), spark.createDataFrame(orphans, schema)
    live = spark.createDataFrame([(e[0],) for e in entries + orphans if "live" in e[0]], "chunk_id string")
    blobs = spark.createDataFrame([(f"p{k}", 1000) for k in range(1, 7)], "pack_id string, size long")
    got = {r.pack_id: r for r in gc.plan(idx, live, blobs, lost).collect()}
    assert {k: v.action for k, v in got.items()} == {"p1": "keep", "p2": "delete", "p3": "defer", "p4": "repack", "p5": "adopt", "p6": "delete_orphan", "p7": "delete"}
    assert got["p4"].reclaimed == 1000 and got["p4"].net == 1000 - 40 - 4 * 36 - 5 and got["p7"].reclaimed == 0
    s = gc.stats(gc.plan(idx, live, blobs, lost)).first()
    assert (s.chunks_live, s.chunks_dead, s.packs_adopt, s.bytes_reclaimed) == (18, 9, 1, 3000)
    assert gc.stats(gc.plan(idx.limit(0), live, blobs.limit(0))).first().chunks_live == 0


def test_deep_check_and_packs(spark):
    key = F.lit(bytes(32))
    rows = spark.createDataFrame([(b"hello" * 100,), (b"x",), (b"",)], "content binary").withColumn("chunk_id", identity.chunk_id(F.col("content")))
    sealed = rows.select("chunk_id", "content", codec.seal(codec.compress(F.col("content")), key, F.col("chunk_id").cast("binary")).alias("blob")).checkpoint()
    assert {r.status for r in verify.deep(sealed, key).collect()} == {"OK"}
    flipped = sealed.withColumn("blob", F.concat(F.substring("blob", 1, 15), F.lit(b"\x00\x01"), F.substring("blob", 18, 10**6)))
    assert {r.status for r in verify.deep(flipped, key).collect()} == {"CORRUPT_AEAD"}
    assert {r.status for r in verify.deep(sealed, F.lit(b"1" * 32)).collect()} == {"CORRUPT_AEAD"}
    built = sealed.agg(files.pack_bytes(F.sort_array(F.collect_list(F.struct("chunk_id", "blob")))).alias("content"))
    good = built.withColumn("name", identity.pack_name(F.sha2("content", 256)))
    read = files.pack_entries(good).collect()
    assert {r.status for r in read} == {"OK"} and len(read) == 3
    content = bytes(good.first().content)
    for r in read:
        assert content[r.offset - 36 : r.offset - 4].hex() == r.chunk_id
    for bad in (b"XXXX" + content[4:], content[:-1], content[:4] + b"\x02" + content[5:], content + b"tail"):
        some = spark.createDataFrame([("packs/" + "0" * 64 + ".pack", bad), ("foreign", b"")], "name string, content binary")
        assert [r.status for r in files.pack_entries(some).collect()][-1] == "PACK_FORMAT"


def test_tree(spark):
    meta = lambda kind: (None, "t" if kind == "symlink" else None, 0o644, 1, 3 if kind == "file" else None, kind, None)
    paths = [("a", "dir"), ("B", "dir"), ("é", "dir"), ("a/x", "file"), ("B/x", "file"), ("é/none", "dir"), ("zero", "file"), ("l", "symlink"), ("a/..", "file")]
    rows = [(p, meta(k), (["c1", "c2"] if p.endswith("x") else []) if k == "file" else None, "h" if k == "file" else None) for p, k in paths]
    entries = spark.createDataFrame(rows, f"path string, meta {tree.META}, chunks array<string>, file_hash string")
    assert [r.path for r in tree.rejected(entries).collect()] == ["a/.."]
    nodes, root = tree.build(entries)
    read = tree.entries_of(nodes).cache()
    walked = tree.walk(read, root).orderBy(F.split("path", "/")).collect()
    assert [r.path for r in walked] == ["B", "B/x", "a", "a/x", "l", "zero", "é", "é/none"]
    by = {r.path: r for r in walked}
    assert by["a"].tree == by["B"].tree != by["é"].tree and by["zero"].chunks == []
    assert {r.status for r in walked} == {"OK"}
    assert nodes.count() == 4  # root, a = B, é, and the empty folder
    assert tree.reachable(read, root).count() == 4 + 2
    top = root.first().node_id
    assert tree.navigate(read, top, "a/x").first().chunks == ["c1", "c2"]
    assert tree.navigate(read, top, "no/x").count() == 0
    with pytest.raises(NotADirectoryError):
        tree.navigate(read, top, "zero/x")
    with pytest.raises(ValueError):
        tree.navigate(read, top, "")
    bad = spark.createDataFrame([("n", "{"), ("p", None), ("q", '{"entries":[null],"v":1}'), ("m", '{"entries":[],"v":9}'), ("o", '{"entries":[{"meta":{"type":"file"},"name":".."}],"v":1}')], "node_id string, payload string")
    assert {(r.node_id, r.status) for r in tree.entries_of(bad).collect()} == {(k, "BAD_NODE") for k in "npqmo"}
    odd = 'tab\t "quotes" back\\slash \x01 é 😀 \u2028'
    nodes, root = tree.build(spark.createDataFrame([(odd, meta("file"), ["c"], "h")], entries.schema))
    import json

    assert json.loads(nodes.first().payload)["entries"][0]["name"] == odd
    assert [r.path for r in tree.walk(tree.entries_of(nodes), root).collect()] == [odd]
    empty_nodes, empty_root = tree.build(entries.limit(0))
    assert empty_nodes.count() == empty_root.count() == 1


def test_restore_faults(spark):
    parts = spark.createDataFrame([("f", 0, b"ab"), ("f", 1, b"cd"), ("g", 0, b"cd"), ("g", 1, b"ab"), ("h", 0, b"ab")], "path string, seq int, data binary")
    want = spark.range(1).select(F.sha2(F.lit(b"abcd"), 256)).first()[0]
    none = spark.range(1).select(F.sha2(F.lit(b""), 256)).first()[0]
    expected = spark.createDataFrame([("f", want, 2), ("g", want, 2), ("h", want, 2), ("i", none, 0)], "path string, file_hash string, n_chunks int")
    got = {r.path: r.status for r in restore.reassemble(parts, ["path"], expected).collect()}
    assert got == {"f": "OK", "g": "FILE_HASH_MISMATCH", "h": "CHUNK_MISSING", "i": "OK"}
