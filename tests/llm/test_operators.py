"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns,
against brute force where SQL has no say."""

import gzip
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.core.broadcast import Broadcast
from pyspark.sql import functions as F

import corpus_pipeline
from cohortflow.llm import (common, components, decontam, line_dedup, mixing, pii, quality, sharding, simhash,
                            token_output, toxicity, warc)
from cohortflow.llm.queries import byte_bpe

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one two", "Same text for all of them here", "Same text for all of them here", LONG,
         LONG + " tail", "é ü  double  space nbsp <|endoftext|> ", "a b c d e f g h i j k l m n o p q r s t"]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, key string, text_key long, "
          "salt int, root long, own_id long, own_row int, epoch int, n_words int, score double")


def rows():
    out = [(i, t, "en", f"src{i % 3}", len(t or ""), *[None] * 10) for i, t in enumerate(TEXTS)]
    return out + [(None, "text without an id", None, None, 18, *[7] * 2, *[None] * 8), out[3], out[6], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(r[0], r[1], r[2], r[3], r[4], None, "k", 1, 1, 1, 1, 1, 1, 1, 1.0) for r in rows()]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(10)] + [(None, 1, None)],
                                 "doc_id long, quality int, toxic int")


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ line dedup

def test_line_dedup(spark):
    page = "<p>menu</p><script>x</script><p>own {}</p>"
    data = [(i, "http://A.example/x", page.format(i)) for i in range(4)]
    data += [(9, None, page.format(9)), (10, "no host", None), (11, "http://b.example", "menu"), (0, *data[0][1:])]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    run = lambda d: line_dedup.site_line_dedup(     # noqa: E731
        d, "page_id", line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html")))
    got = {(r["page_id"], r["host"]): r for r in run(pages).collect()}
    assert run(pages).count() == len(data)
    assert got[1, "a.example"]["text"] == "own 1" and got[1, "a.example"]["n_dropped"] == 1
    assert got[0, "a.example"]["host_pages"] == 5
    assert got[9, None]["text"] == "menu\nown 9" and got[10, None]["text"] == ""
    assert got[11, "b.example"]["text"] == "menu"
    assert run(pages.limit(0)).count() == 0


# --------------------------------------------------------------------- quality

def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c a b", "x|y\nx|y\n \n\nx|y", "é ü a\x85b é", "a a a a"])
def test_statistics(text):
    assert quality.statistics(text)[:5] == brute_statistics(text)


def test_trees_fall_with_constrained_feature():
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    y = ((x[:, 0] + 0.4 * rng.standard_normal(600)) > 0.5).astype(float)
    trees = quality.train(x, y, falling=(0,))
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.3)])
    assert (np.diff(trees.score(grid)) <= 1e-12).all()
    free = quality.train(x, y)
    assert ((free.score(x) > 0.5) == y).mean() > 0.75


def test_quality(docs, empty, labels):
    trees = quality.fit(docs, labels)
    got = quality.verdicts(docs, trees).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.verdicts(empty, trees).count() == 0 and quality.keep_good(empty, labels).count() == 0
    assert quality.fit(docs, labels.limit(0)).score(np.zeros((1, len(quality.FEATURES))))[0] > 0.99


# --------------------------------------------------------------------- SimHash

def test_samples_are_bounded(spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 1)] * 60 + [(i, i % 2, i % 2) for i in range(40)],
                                   "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(7, f"text {i % 50}") for i in range(500)] + [(i, f"own {i}") for i in range(40)],
                                 "doc_id long, text string")
    sizes = []
    monkeypatch.setattr(quality, "train", lambda x, y, falling: sizes.append(len(y)))
    monkeypatch.setattr(toxicity, "train", lambda texts, y: sizes.append((len(texts), len(set(texts)))))
    quality.fit(docs, labels, max_rows=30)
    toxicity.fit(docs, labels, max_rows=20)
    assert sizes == [30, (20, 20)]
    # repeated labels and texts crowd no id out
    chosen = common.sample_labels(labels.select(F.col("doc_id").alias("own_id"), F.col("toxic").alias("label")), 40)
    rows = common.sample_texts(docs.withColumnRenamed("doc_id", "own_id"), chosen, 40, "test")
    assert sorted(r["own_id"] for r in rows.collect()) == list(range(40))


def brute_fingerprint(text, width=4):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    return [min((ids[j] for j in range(len(fps)) if root[j] == root[i] and ids[j] is not None), default=None)
            for i in range(len(fps))]


def test_golay_decodes_within_three_bits():
    golay = simhash.Golay()
    v = np.random.default_rng(2).integers(0, 1 << 23, 2000)
    code = golay.decode(v)
    word = (code << 11) | golay.high[code]
    assert np.bitwise_count(word ^ v).max() <= 3
    near = golay.fuzzy(v, 23)
    assert (near >= 0).sum(axis=1).max() <= 6


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    golay = simhash.Golay()
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    rows_a, keys_a = simhash.fuzzy_keys(a, golay)
    rows_b, keys_b = simhash.fuzzy_keys(b, golay)
    shared = set(zip(rows_a.tolist(), keys_a.tolist())) & set(zip(rows_b.tolist(), keys_b.tolist()))
    assert {r for r, _ in shared} == set(range(len(a)))


def test_simhash(docs, empty):
    data = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in data]
    ids = [r["doc_id"] for r in data]
    comps = brute_components(ids, fps)
    want = sorted(zip(ids, [f"{f:016x}" for f in fps], comps), key=repr)
    assert found(simhash.simhash_components(docs)) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(
        {c for c in comps if c is not None})
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_link_dense_and_chained_groups(spark):
    """A ball of near fingerprints, and a chain whose ends are far apart."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False))
           for _ in range(300)}
    at = int(rng.integers(0, 1 << 62))
    for step in range(40):
        fps.add(at)
        at ^= sum(1 << ((4 * step + k) % 62) for k in range(4))
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    got = dict(simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long")).collect())
    mine = [got.get(f, f) for f in signed]
    want = brute_components(list(range(len(fps))), fps)
    groups = lambda x: {frozenset(np.flatnonzero(np.array(x) == v).tolist()) for v in set(x)}
    assert groups(mine) == groups(want)


def test_components_of_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (200, 200)], "a long, b long")
    got = dict(components.components(edges, "a", "b").collect())
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


# ------------------------------------------------------------- decontamination

def brute_hits(text, items, window=10):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words_of = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))             # noqa: E731
    words, hit, got = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        m = min(window, len(own))
        grams = {tuple(own[o:o + m]) for o in range(len(own) - m + 1)} if m else set()
        for p in range(len(words) - m + 1) if m else []:
            if tuple(words[p:p + m]) in grams:
                hit |= set(range(p, p + m))
                got.add(str(name))
    return len(words), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, empty, block_bytes):
    passage = " ".join(f"q{i}" for i in range(14))
    items = [(1, passage), (2, "one two"), (10, passage), (3, None), (4, "..."), (5, LONG[:200])]
    more = [(20, f"before {passage.upper()}, after", *[None] * 13), (21, " ".join(passage.split()[:9]), *[None] * 13)]
    every = docs.union(spark.createDataFrame(more, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.matches(every, bench, block_bytes=block_bytes))
    want = sorted(((r["doc_id"], *brute_hits(r["text"], items)) for r in every.collect()), key=repr)
    assert found(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256")) == want
    hit = got.filter("doc_id = 20").first()
    assert hit["contaminated"] and (hit["longest_words"], hit["longest_start"]) == (14, 1)
    clean = decontam.remove_contaminated(every, bench)
    assert clean.columns == docs.columns and clean.count() == sum(1 for w in want if w[2] == 0)
    assert decontam.matches(empty, bench).count() == 0
    assert decontam.digest(decontam.matches(docs, bench.limit(0))).filter("contaminated").count() == 0


def test_blocks_share_scans_and_are_let_go(spark, docs, monkeypatch):
    """Four blocks meet the documents in one scan and are destroyed; hits and longest matches are those of a single block."""
    data = [(i, f"{' '.join(LONG.split()[i * 7:i * 7 + 12])} item {i}") for i in range(120)]
    bench = spark.createDataFrame(data, "item_id long, text string")
    scans, gone, write = [], [], decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df, label: scans.append(label) or write(df, label))
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: gone.append(1) or destroy(self, *a))
    many = decontam.matches(docs, bench, block_bytes=2_000)
    assert len(gone) > 8 and scans.count("decontam-scan") == -(-len(gone) // decontam.SCAN_BLOCKS)
    assert sum(1 for r in many.select("n_hit").collect() if r["n_hit"]) == 3
    assert found(decontam.digest(many)) == found(decontam.digest(decontam.matches(docs, bench)))


def test_blocks_are_bounded(spark, docs, monkeypatch):
    data = [(7, "the same item again")] * 400 + [(i, f"item {i} " * (i % 9)) for i in range(200)]
    bench = spark.createDataFrame(data, "item_id long, text string")
    blocks, start = [], decontam.Block.__init__
    monkeypatch.setattr(decontam.Block, "__init__",
                        lambda self, items, window: blocks.append(list(items)) or start(self, items, window))
    decontam.matches(docs, bench, block_bytes=16_384)
    held = [sum(len(t) + len(n) + 64 for n, t in items) for items in blocks]
    assert max(held) <= 8_192 and len(held) <= 2 * -(-sum(held) // 8_192)
    assert sorted(x for items in blocks for x in items) == sorted({(str(i), t.encode()) for i, t in data})


# ---------------------------------------------------------------------- mixing

def test_mixing(docs, empty):
    spec = mixing.MixSpec(weights={("other",): 1}, budget_share=1.5, max_epochs=2)
    levels = mixing.corpus_levels()
    got = mixing.mix(docs, spec, levels).toPandas()
    total = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert got["n_tokens"].sum() <= 1.5 * total
    assert (got.groupby(["doc_id", "epoch"], dropna=False).size() <= 2).all()       # repeated rows go together
    whole = mixing.mix_documents(docs, mixing.MixSpec(budget_share=1.0), levels)
    assert whole.columns == docs.columns
    assert mixing.mix(empty, spec, levels).count() == 0 and mixing.mix_documents(empty, spec, levels).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "x", "1", 1000)],
                                   "domain string, lang string, source string, tokens long")
    spec = mixing.MixSpec(budget_share=0.1, max_epochs=1)
    got = {(r["domain"], r["source"]): r["target"] for r in mixing.leaf_targets(leaves, spec).collect()}
    assert got == {("a", "1"): 10, ("a", "2"): 90, ("b", "1"): 100}


def test_mix_meets_its_budget(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, f"d{i % 3}", f"l{i % 2}", f"s{i % 5}", int(n)) for i, n in
            enumerate(np.where(rng.random(300) < 0.1, 5000, rng.integers(1, 200, 300)))]
    light = spark.createDataFrame(data, "doc_id long, domain string, lang string, source string, n_tokens long")
    spec = mixing.MixSpec(weights={("d0",): 3, ("d1", "l1"): 2}, budget_share=0.4)
    plan = mixing.leaf_plan(light, spec)
    got = mixing.take(light, plan, spec).toPandas()
    budget = int(sum(r[4] for r in data) * 0.4)
    assert budget - 5000 < got["n_tokens"].sum() <= budget         # 5,000: the longest document
    sums = got.groupby(list(spec.levels))["n_tokens"].sum()
    assert all(abs(sums.get((r["domain"], r["lang"], r["source"]), 0) - r["target"]) < 5000 for r in plan.collect())
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)             # the plan met by a shuffle: the same rows
    again = mixing.take(light, mixing.leaf_plan(light, spec), spec).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, got.values.tolist()))
    monkeypatch.setattr(mixing, "_filled", lambda cut, spec: cut)  # nothing handed on
    plain = mixing.take(light, mixing.leaf_plan(light, spec), spec).toPandas()
    assert plain["n_tokens"].sum() < budget - 5000


# ---------------------------------------------------------------- token output

def test_tokens(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(byte_bpe())
    tokenizer.encode_special_tokens = True
    got = sorted(token_output.token_documents(docs, byte_bpe(), length=64).collect(), key=lambda r: r["start"])
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).collect()
    data = [(r["doc_id"], r["text"]) for r in sorted(keyed, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] or ""))]
    start = 0
    for (doc_id, text), r in zip(data, got, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_output.token_documents(empty, byte_bpe()).count() == 0
    files = token_output.write_tokens(docs, str(tmp_path / "t"), byte_bpe(), length=64).collect()
    file = token_output.TokenFile(max(files, key=lambda r: r["n_tokens"])["path"])
    ids, mask = file.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata


def test_a_token_task_gives_unused_memory_back(docs, tmp_path, monkeypatch):
    import pyspark

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(n) for n in re.findall(r"\nPss_Anon:\s+(\d+)", f.read())) / 1024

    task = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: task.append(run) or self)
    monkeypatch.setattr(token_output, "materialize", lambda df, label: df)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    token_output.write_tokens(docs, str(tmp_path / "t"), byte_bpe())
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(10_000))
    batch = pa.record_batch({"doc_id": pa.array(range(200), pa.int64()), "text": pa.array([text] * 200)})
    list(task[0](iter([batch])))
    kept = held()
    pa.default_memory_pool().release_unused()
    assert kept - held() < 20           # MB; 59 without giving back


def test_ids_of_any_blanks_equal_the_tokenizer():
    parts = token_output.parts_of(byte_bpe())
    rng = np.random.default_rng(3)
    pieces = [" ", "\n", "a", "bc", ".", "1", "é", "\r", "\t", " x", "\ny", "'s", "<|endoftext|>", "\x1c", "漢", "zz,", "\x85"]
    for _ in range(60):
        texts = ["".join(rng.choice(pieces, rng.integers(0, 15))) for _ in range(80)]
        ids, sizes = parts.encode_all(texts, 2)
        for text, end, n in zip(texts, np.cumsum(sizes), sizes):
            want = parts.tokenizer.encode(text, add_special_tokens=False).ids + [2]
            assert ids[end - n:end].tolist() == want


def test_few_parts_are_kept(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE", 5)
    parts = token_output.Parts(token_output.parts_of(byte_bpe()).tokenizer, "<u2")
    words = [f"word{i}" for i in range(12)] + ["\nline", "mark,"]
    for _ in range(3):
        for at in range(0, len(words), 3):
            some = words[at:at + 3]
            starts, sizes, flat = parts.known(pa.array(some, pa.large_string()))
            for w, i, n in zip(some, starts, sizes):
                assert flat[i:i + n].tolist() == parts._ids(w if w[0] == "\n" else " " + w).tolist()
        assert len(parts.parts) == len(parts.sizes) <= 6


def test_one_id_is_dealt_to_several_files(spark, tmp_path):
    one = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # else so few rows share a task
    files = token_output.write_tokens(one, str(tmp_path / "t"), byte_bpe())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert files.count() > 1 and token_output.read_tokens(files, str(tmp_path / "t")).count() == 4000


# -------------------------------------------------------------------- sharding

def test_hilbert_curve_moves_one_cell_at_a_time():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute_cells(values, bits):
    """Cell of each text: the number of cuts up to it; a cut is a value that completes a further 1/2**bits of the rows."""
    known = sorted(v for v in values if v is not None)
    cuts = [v for v in sorted(set(known))
            if (sum(x <= v for x in known) << bits) // len(known) > (sum(x < v for x in known) << bits) // len(known)]
    return [0 if v is None else min(sum(c <= v for c in cuts), (1 << bits) - 1) for v in values]


def test_shards_of_texts_that_start_alike_equal_brute_force(spark):
    """Sources with one long common start, one of them hot, get cells of their own; order, sizes and crc by brute force."""
    rng = np.random.default_rng(4)
    data = []
    for i in range(400):
        host = "hot" if i % 3 == 0 else f"é{rng.integers(40)}"
        data.append((i, None if i % 50 == 7 else f"text ü {i % 60}", None if i % 41 == 5 else f"https://common/{host}",
                     ["de", "en", None][i % 3]))
    own = spark.createDataFrame(data, "doc_id long, text string, source string, lang string").repartition(5)
    got = sharding.hilbert_shards(own, {"lang": F.col("lang"), "source": F.col("source")}, shards=7, bits=4)
    cells = np.array([brute_cells([r[3] for r in data], 4), brute_cells([r[2] for r in data], 4)]).T
    assert len(set(cells[:, 1].tolist())) > 8
    index = sharding.hilbert_index(cells, 4).tolist()
    raw = [(r[1] or "").encode() for r in data]
    order = sorted(range(400), key=lambda i: (index[i], i))
    first = {s: min(p for p in range(400) if p * 7 // 400 == s) for s in range(7)}
    want = {i: (len(raw[i]) + 1, zlib.crc32(raw[i]), index[i], p * 7 // 400, p - first[p * 7 // 400])
            for p, i in enumerate(order)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["hilbert"], r["shard"], r["slot"])
            for r in got.collect()} == want


def test_sharding(docs, empty, tmp_path):
    dims = {"lang": F.col("lang"), "length": F.length("text")}
    cut = sharding.hilbert_shards(docs, dims, shards=4)
    got = cut.toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == docs.count() and counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert set(got["size"][got["text_crc32"] == 0]) == {1}
    assert sharding.shard_ranges(cut).count() == 4
    sharding.write_shards(docs, cut, str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()
    assert sharding.hilbert_shards(empty, dims).count() == 0


# ------------------------------------------------------------------------ WARC

@pytest.mark.parametrize("length, digest", [(3, hashlib.sha256(b"abcd").hexdigest()), (4, "0" * 64)])
def test_warc_header_must_match(spark, length, digest):
    raw = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\n"
           f"WARC-Payload-Digest: sha256:{digest}\r\nX-Page-ID: 1\r\nX-Payload-Length: {length}\r\n"
           "Content-Length: 4\r\n\r\nabcd\r\n\r\n")
    with pytest.raises(OSError):
        list(warc.chunks_of(io.BytesIO(gzip.compress(raw.encode()))))
    chunks = spark.createDataFrame([("r", 1, "response", None, 9, 0, True, 4, "d", b"abcd")], warc.CHUNKS)
    with pytest.raises(Exception, match="another length"):
        warc.records(chunks).collect()


def test_warc(spark, monkeypatch):
    big = "x" * 700_000 + "WARC/1.1\r\n\r\né"
    html = {5: big, 3: big, 4: None, 7: "", 8: "short", 9: "short", 10: "y" * 100, 11: "y" * 99}
    data = [(i, "http://a b/\n", h) for i, h in html.items()] + [(3, "u", big), (None, None, big)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    chunks = warc.archive_pages(spark, pages)
    got = found(warc.records(chunks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    want = []
    for i, _, h in data:
        raw = (h or "").encode()
        revisit = h is big and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
                     3 if revisit else None))
    assert got == sorted(want, key=repr)
    one = chunks.filter("page_id = 3").orderBy("record_id", "chunk_no").collect()
    assert max(r["chunk_no"] for r in one) == 2 and max(len(r["data"]) for r in one) <= warc.CHUNK
    whole = b"".join(r["data"] for r in one if r["record_id"] == one[0]["record_id"])
    assert whole == big.encode()
    assert warc.records(warc.archive_pages(spark, pages.limit(0))).count() == 0


# ------------------------------------------------------------------------- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("text", ["a@b.c@d.e", "x@y z@w.com.", "..@a.b_c@d.e-f", "@a.b", "a@@b.c", "é@a.b a@b.c.@d.e"])
def test_emails_are_leftmost(text):
    assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]


def test_personal_data(spark, docs, empty):
    texts = {1: "mail jo@x.example.com, call +1 (415) 555-0123 now", 2: "ip 10.0.0.256 and 10.0.0.255",
             3: "card 4539 1488 0343 6467 and 4539148803436468", 4: None, 5: "Dr. Anna Smith says 978-3-16-148410-0"}
    own = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(own)).collect()}
    assert (got[1]["n_email"], got[1]["n_phone"], got[2]["n_ip"], got[3]["n_card"]) == (1, 1, 1, 1)
    assert got[4]["spans"] == "" and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["spans"].startswith("email:5:21,phone:28:")
    assert pii.redact(texts[1], [(5, "email", 21)]) == "mail [email], call +1 (415) 555-0123 now"
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(empty).count() == 0


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = np.random.default_rng(4)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = [1 if (rng.random() < good) == y else -1 for good in (0.9, 0.85, 0.55)]
        key = ("name", 0, *votes, 0, 0)
        counts[key] = counts.get(key, 0) + 1
    chance, tables = pii.reliabilities(counts)
    share, table = tables["name"]
    told = table[1] - table[0]
    assert 0.3 < share < 0.7 and min(told[0], told[1]) > 0.5 > told[2] + 0.2
    assert chance["name", 0, 1, 1, 1, 0, 0] > 0.9 > 0.1 > chance["name", 0, -1, -1, -1, 0, 0]
    counts["name", 1, -1, -1, -1, 0, 0] = 50                # known to be personal data, whatever the votes say
    assert pii.reliabilities(counts)[0]["name", 1, -1, -1, -1, 0, 0] == 1


def base_by_regex(text):
    """The base kinds as the plain patterns say them."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, pii.BASE_KINDS[k], e) for s, k, e in sorted(out)]


def test_base_spans_equal_the_plain_patterns_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in pii.digest(pii.find_personal_data(docs)).collect()}
    for r in docs.collect():
        want = base_by_regex(r["text"])
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        out = got[r["doc_id"]]
        assert out["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [out[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[1] == k for x in want) for k in pii.BASE_KINDS]
        tokens = re.findall(r'token = "([0-9a-f]{40})"', r["text"])
        assert out["n_secret"] >= len(tokens) and out["n_spans"] >= len(want) + len(tokens)


def test_the_classifier_knows_base_spans_and_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classifier, tables = pii.learn(docs)
    for r in docs.select("text").collect():
        own = pii.base_spans(r["text"])
        for s, e, kind, votes, features in pii.candidates(r["text"]):
            if any((s, e) == (a, b) for a, _, b in own):
                assert classifier.probability(features) > 0.9
    assert {"email", "ip", "card", "phone", "secret"} <= set(tables)


@pytest.mark.parametrize("text,kinds", [
    ('api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', {"secret"}), ("token: ghp_abcdefghij0123456789ABCDEFGHIJ012345", {"secret"}),
    ("commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b of", set()), ("https://example.com/a/very/long/path1/of/parts", set()),
    ("1111111111111111111111111111111111111111", set()), ("averyveryverylongwordwithoutanydigit", set())])
def test_secret_candidates(text, kinds):
    counts = {}
    for t in [text, 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" x'] * 50:
        for v, f in pii.known_candidates(t):
            counts[v, f] = counts.get((v, f), 0) + 1
    votes = {}
    for (v, _), n in counts.items():
        votes[v] = votes.get(v, 0) + n
    chance, _ = pii.reliabilities(votes)
    classifier = pii.SpanClassifier([(f, chance[v], float(n)) for (v, f), n in counts.items()])
    assert {k for *_, k, _, f in pii.candidates(text) if classifier.probability(f) >= 0.9} == kinds


# -------------------------------------------------------------------- toxicity

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    s, moves = rng.normal(size=(1, 6)), rng.normal(size=3)
    step = np.array([[0, moves[0]], [moves[1], moves[2]]])
    weight, ones = 0.0, np.zeros(6)
    for tags in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(s[0, i] * t for i, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:])))
        weight += w
        ones += w * np.array(tags)
    logit = toxicity.marginals(s, np.ones((1, 6), dtype=bool), moves)[0][0]
    assert np.allclose(1 / (1 + np.exp(-logit)), ones / weight)


def test_long_texts_are_one_chain(monkeypatch):
    rng = np.random.default_rng(9)
    field = toxicity.Field(rng.normal(size=1 << toxicity.BITS), -0.3, np.array([-2.0, -1.5, 2.5]))
    texts = [" ".join(rng.choice(["ab", "cde", "fgh", "ijklm", "no"], n)) for n in (700, 3, 64, 0, 65, 129, 640)]
    got = toxicity.scan(texts, toxicity.Scores(field), spans=True)
    monkeypatch.setattr(toxicity, "CHAIN", 1024)
    whole = toxicity.scan(texts, toxicity.Scores(field), spans=True)
    assert [x for _, x in got] == [x for _, x in whole]
    assert np.allclose([x for x, _ in got], [x for x, _ in whole], rtol=0, atol=1e-9)


def test_toxicity(spark, docs, empty, labels):
    rng = np.random.default_rng(8)
    vocab = ["river", "stone", "cloud", "paper", "green", "light", "table", "house", "water", "music"]
    data = []
    for i in range(400):
        words = list(rng.choice(vocab, 30))
        if i % 4 == 0:
            words[7] = ["grobbish", "snarkle"][i // 4 % 2]
        data.append((i, " ".join(words), int(i % 4 == 0)))
    own = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None), (900, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_scores(own, known).collect()}
    assert len(got) == 402 and all(got[i]["predicted"] == y for i, _, y in data)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    a, b = map(int, got[0]["spans"].split(",")[0].split(":"))
    assert data[0][1][a:b] == "grobbish" and got[900]["predicted"] == 0 and got[None]["spans"] == ""
    assert toxicity.toxic_scores(docs, labels.limit(0)).filter("score = 0").count() == docs.count()
    assert toxicity.toxic_scores(empty, known).count() == 0


# -------------------------------------------------------------------- pipeline

def test_pipeline_stages_on_edge_rows(spark, docs, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf)
            if name != "token_output":
                assert out.columns == docs.columns
            rows = out.collect()
            now = spark.createDataFrame(rows, out.schema)
        assert now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_rows_equal_brute_force(spark, tmp_path, monkeypatch):
    """Who leaves at each stage, and the last stage's tokens, on short, repeated, near and contaminated documents."""
    from tokenizers import Tokenizer
    rng = np.random.default_rng(12)
    vocab = [f"word{i}" for i in range(3_000)]
    texts = [" ".join(rng.choice(vocab, 300)) for _ in range(40)]
    passage = " ".join(rng.choice(vocab, 12))
    texts += [texts[3], texts[3], texts[5] + " end", texts[6] + " " + passage, "too short", None, "same word " * 80, ""]
    sources = [f"src{i % 4}" for i in range(len(texts))]
    data = [(i, t, ["en", "de"][i % 2], s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))]
    sf = str(tmp_path)
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("b1", passage)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(
        f"{sf}/labels.parquet")
    out, write = {}, corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize",
                        lambda df, label: out.setdefault(label, write(df, label)))
    last = corpus_pipeline.run(spark, sf).collect()

    ids = lambda stage: sorted(r["doc_id"] for r in out[f"stage-{stage}"].collect())      # noqa: E731
    good = [i for i, t in enumerate(texts) if t and len(t.split()) >= 50 and i != 46]
    assert ids("quality_rules") == good
    single = sorted(set(brute_components(good, [brute_fingerprint(texts[i]) for i in good])))
    assert {3, 5} <= set(single) and not {40, 41} & set(single)
    assert ids("simhash_near_dedup") == single
    clean = [i for i in single if not brute_hits(texts[i], [("b1", passage)])[1]]
    assert ids("decontamination") == clean and 43 not in clean
    mixed = ids("mixing")
    size = {i: len(texts[i].split()) for i in clean}
    assert set(mixed) <= set(clean) and abs(sum(size[i] for i in mixed) - sum(size.values())) < 2 * max(size.values())

    tokenizer, start = Tokenizer.from_file(byte_bpe()), 0
    for doc, r in zip(mixed, sorted(last, key=lambda r: r["start"]), strict=True):
        tokens = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, start, len(tokens))
        assert r["ids_crc32"] == zlib.crc32(np.array(tokens, dtype="<u4").tobytes())
        start += len(tokens)
