"""Cases that once went wrong, comparisons with brute force, and odd tables."""

import gc
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.llm import chat, minhash, mixing, packing, quality, suffix, tiff, tokens, topk, warc
from sonarium.llm.queries import tokenizer_file
from tests.llm import brute

# Mixing.

SIZES = {"a": 50.0, "b": 30.0, "c": 20.0}


def fit(target, limit, budget, sizes=SIZES):
    logs = np.log(np.array(list(sizes.values())) / max(sizes.values()))

    def sums(a):
        w, end = np.exp(a * logs), np.exp((a - 1) * logs)
        return mixing.Shares(w.sum(), (w * logs).sum(), end.max(), end.min())

    return mixing.bisect_exponent(sums, target, limit, budget, sum(sizes.values()), max(sizes.values()), len(sizes))


def test_the_target_entropy_is_met_from_both_sides():
    for target in (0.999, 0.95, 0.8, 0.5, 0.1):
        mix = fit(target, 100.0, 100.0)
        assert mix.entropy == pytest.approx(target, abs=1e-9) and mix.rule == "entropy"
    assert fit(0.999, 100.0, 100.0).exponent < 1 < fit(0.8, 100.0, 100.0).exponent


def test_the_repetition_limit_is_reached_from_both_sides():
    for target in (1.0, 0.2):
        mix = fit(target, 1.2, 100.0)
        assert mix.rule == "repeats" and mix.repeats == pytest.approx(1.2, abs=1e-6) and mix.budget == pytest.approx(100)
    mix = fit(0.8, 1.5, 1000.0)  # the budget alone is too much
    assert (mix.exponent, mix.repeats, mix.budget) == (1.0, 1.5, 150.0)


def test_mixes_of_odd_sources():
    assert fit(0.5, 4.0, 10.0, {"a": 7.0}).entropy == 1.0
    alike = fit(0.5, 4.0, 10.0, {"a": 5.0, "b": 5.0})
    assert alike.entropy == pytest.approx(1.0) and alike.exponent == 1.0
    two = fit(0.3, 50.0, 10.0, {"a": 5.0, "b": 5.0, "c": 1.0})  # two largest alike: no exponent goes below ln 2
    assert two.rule == "end" and two.entropy == pytest.approx(np.log(2) / np.log(3))
    whole = fit(0.8, 100.0, None)
    assert min(whole.budget * w / SIZES[s] for s, w in zip(SIZES, weights_at(whole.exponent), strict=True)) == pytest.approx(1.0)


def weights_at(a):
    w = np.array(list(SIZES.values())) ** a
    return w / w.sum()


@pytest.mark.parametrize("target, limit, passes", [(0.9, 3.0, 1.5), (0.99, 2.0, 1.0), (0.5, 9.0, 0.7)])
def test_the_stream_is_that_of_a_serial_reader(spark, target, limit, passes):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 3, 9, 40]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [rows[5], rows[6], (900, None, "a"), (901, "", "silent")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit(7) for c in ("epochs", "weight", "b1", "mix_key", "tokens", "entry")})
    out = mixing.mix_stream(docs, target_entropy=target, max_repeats=limit, passes=passes)
    got = out.collect()
    sizes = {}
    for _, text, source in rows:
        name = "null" if source is None else "=" + source
        sizes[name] = sizes.get(name, 0) + len((text or "").split())
    budget = passes * sum(sizes.values())
    weights = {r.mix_source: r.mix_weight for r in got}
    want = brute.mix_weights({k: v for k, v in sizes.items() if v}, target, limit, budget)
    assert all(weights[s] == pytest.approx(w, abs=2e-3) for s, w in want.items())
    assert len({r.mix_epoch for r in got}) > 1 or passes < 1
    assert sorted(((r.mix_source, r.doc_id, r.mix_epoch) for r in got), key=str) == brute.mix_stream(rows, weights, budget)
    assert {(r.epochs, r.weight, r.b1, r.tokens) for r in got} == {(7, 7, 7, 7)}  # the caller's own columns
    # Within a source the stream goes block by block, by the order that rows bear.
    one = sorted((r for r in got if r.mix_source == "=a"), key=lambda r: (r.mix_epoch, r.mix_order, r.mix_block, r.mix_key % 2**64))
    blocks = [(r.mix_epoch, r.mix_block) for r in one]
    assert len([1 for a, b in zip(blocks, blocks[1:], strict=False) if a != b]) + 1 == len(set(blocks))


# Media.


def tags_of(data, order="<"):
    at = struct.unpack_from(order + "I", data, 4)[0]
    (n,) = struct.unpack_from(order + "H", data, at)
    return {struct.unpack_from(order + "H", data, at + 2 + 12 * i)[0]: at + 2 + 12 * i for i in range(n)}


def changed(data, tag, value=None, count=None):
    out = bytearray(data)
    at = tags_of(data)[tag]
    if count is not None:
        struct.pack_into("<I", out, at + 4, count)
    if value is not None:
        struct.pack_into("<I", out, at + 8, value)
    return bytes(out)


GREY = np.arange(40 * 30, dtype=np.uint8).reshape(40, 30, 1)


def broken_files():
    strips = tiff.write_tiff([GREY], tiff.PACKBITS, strip_rows=4)
    tiles = tiff.write_tiff([GREY], tiff.DEFLATE, tile=(16, 16))
    return {
        "rows per strip 0": changed(strips, 278, 0), "three of ten strips": changed(changed(strips, 273, count=3), 279, count=3),
        "fewer sizes than strips": changed(strips, 279, count=3), "too many strips": changed(strips, 278, 8), "width 0": changed(strips, 256, 0), "height 0": changed(strips, 257, 0),
        "no channels": changed(strips, 277, 0), "tile width 0": changed(tiles, 322, 0), "tile height 0": changed(tiles, 323, 0), "huge": changed(changed(strips, 256, 400_000), 257, 400_000),
        "huge height": changed(strips, 257, 4_000_000_000), "unknown compression": changed(strips, 259, 77), "twelve bits": changed(strips, 258, 12), "strips beyond the file": strips[:-300], "empty": b"", "no tiff": b"GIF89a.." * 4,
    }


@pytest.mark.parametrize("name", sorted(broken_files()))
def test_broken_files_are_errors_not_holes(name):
    with pytest.raises(tiff.TiffError):
        list(tiff.read_tiff(broken_files()[name]))


def test_pages_of_a_table_with_clashing_names(spark):
    files = [(1, tiff.write_tiff([GREY, GREY + 1])), (2, broken_files()["huge"]), (3, None), (4, b"")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "own", i) for i, b in files], "id int, content binary, width string, page int").withColumn("tiff_error", F.lit("x"))
    rows = tiff.tiff_pages(df)
    assert len(set(rows.columns)) == len(rows.columns) and "content" not in rows.columns
    got = sorted((r.id, r.page is None, r.width, r.tiff_error is None) for r in rows.collect())
    assert got == [(1, False, 30, True), (1, False, 30, True), (2, True, None, False), (3, True, None, False), (4, True, None, False)]


def page_file(width, height, bits, raw, compression=1, channels=1, predictor=1, fill=1, photometric=1):
    """A file of one strip, written by hand."""
    data = b"II*\0" + struct.pack("<I", 8 + len(raw) + (len(raw) & 1)) + raw + b"\0" * (len(raw) & 1)
    fields = {256: width, 257: height, 258: bits, 259: compression, 262: photometric, 266: fill, 273: 8, 277: channels, 278: height, 279: len(raw), 317: predictor}
    return data + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(fields.items())) + b"\0\0\0\0"


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_samples_of_few_bits(bits):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (9, 13)).astype(np.uint8)
    planes = (image[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    raw = b"".join(np.packbits(row.reshape(-1)).tobytes() for row in planes)
    for compression, pack in ((1, bytes), (tiff.PACKBITS, tiff.packbits_encode), (tiff.LZW, tiff.lzw_encode), (tiff.DEFLATE, zlib.compress)):
        (page,) = tiff.read_tiff(page_file(13, 9, bits, pack(raw), compression))
        assert page["samples"] == image.tobytes() and len(tiff.tile_hash(page)) == 16
    turned = np.packbits(np.unpackbits(np.frombuffer(raw, np.uint8)), bitorder="little").tobytes()
    (page,) = tiff.read_tiff(page_file(13, 9, bits, turned, fill=2))
    assert page["samples"] == image.tobytes()


@pytest.mark.parametrize("kind", ["<u2", "<u4", "<f4"])
def test_predictors_of_wide_samples(kind):
    image = np.random.default_rng(3).integers(0, 60_000, (7, 11)).astype(kind)
    size = image.itemsize
    if kind != "<f4":
        steps = np.concatenate([image[:, :1], image[:, 1:] - image[:, :-1]], axis=1)
        (page,) = tiff.read_tiff(page_file(11, 7, 8 * size, steps.tobytes(), predictor=2))
        assert page["samples"] == image.tobytes()
    planes = image.astype(">" + kind[1:]).view(np.uint8).reshape(7, 11, size).transpose(0, 2, 1).reshape(7, -1)
    steps = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1)
    (page,) = tiff.read_tiff(page_file(11, 7, 8 * size, steps.tobytes(), predictor=3))
    assert page["samples"] == image.tobytes()


def test_lzw_goes_on_with_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    codes, table, word = [256], {bytes([i]): i for i in range(256)}, b""
    for i in data:
        after = word + bytes([i])
        if after in table:
            word = after
            continue
        codes.append(table[word])
        if len(table) + 2 < 4096:
            table[after] = len(table) + 2
        word = bytes([i])
    codes += [table[word], 257]
    widths = [9, *tiff._code_widths(len(codes) - 1).tolist()]
    bits = "".join(format(c, f"0{w}b") for c, w in zip(codes, widths, strict=True))
    raw = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    assert len(codes) > 6000 and tiff.lzw_decode(raw, len(data)) == data


# Quality.


def test_weights_are_those_of_gradient_descent():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    true = rng.normal(size=x.shape[1])
    good = x @ true + rng.normal(size=600) > 0
    model = quality.fit_pairs(x, good, pairs=4000, penalty=1e-2)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(good), 4000)] - z[draw.choice(np.flatnonzero(~good), 4000)]
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        w -= 0.3 * (d.T @ (1 / (1 + np.exp(-d @ w)) - 1) / len(d) + 1e-2 * w)
    assert np.abs(w - model.weights).max() < 1e-4
    u = np.sort(z @ w)
    cuts = (u[1:] + u[:-1]) / 2
    accuracy = [((z @ w >= c) & good).sum() / good.sum() / 2 + ((z @ w < c) & ~good).sum() / (~good).sum() / 2 for c in cuts]
    assert model.accuracy == pytest.approx(max(accuracy), abs=1e-3)


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    right = sum((r.score >= 0.3) == bool(r.quality) for r in rows) / len(rows)
    above = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 300 and right > 0.98 and above > 0.99
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_repeated_ids_count_once_in_training(spark):
    rows = [(i, f"good words {i} " * 20) if i % 2 else (i, "bad### " * (10 + i)) for i in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.unionByName(once.withColumn("text", F.concat("text", F.lit(" more")))).unionByName(once).repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [quality.train(often.repartition(n), labels, sample=25) for n in (1, 5)]
    assert models[0] == models[1]  # whatever the order of the rows
    seen = quality.train(often.where("doc_id < 0"), labels)
    assert seen == quality.PairwiseModel()
    kept = quality.keep_good(often.withColumn("score", F.lit("own")), labels)
    assert {r.doc_id % 2 for r in kept.collect()} == {1} and kept.columns == ["doc_id", "text", "score"]
    assert quality.keep_good(once.limit(0), labels).count() == 0


# Search.


def test_like_vectors_are_found_without_looking_at_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(size=(30, 8)) * 300, 4, axis=1)  # like neighbours, as in a smooth signal
    x = np.floor(np.repeat(centres, 80, axis=0) + rng.normal(size=(2400, 32)) * 12)
    ids = np.arange(2400)
    shares = topk.pruned_shares(ids[::20], x[::20], ids, x, 5)
    levels = [shares[n] for n in sorted(shares)]
    assert list(shares) == [1, 2, 4, 8, 16] and levels == sorted(levels, reverse=True) and levels[-1] < 0.2
    i, j, score = topk.block_topk(ids[::20], x[::20], np.full(120, -np.inf), ids, x, 5)
    products = (x[::20] @ x.T).astype(np.int64)
    for q in range(120):
        products[q, ids[::20][q]] = -(2**62)
        want = sorted(zip(-products[q], ids, strict=True))[:5]
        assert [(-s, r) for r, s in sorted(zip(j[i == q], score[i == q], strict=True), key=lambda t: (-t[1], t[0]))] == want


def test_pairs_of_blocks_are_left_out_where_they_cannot_matter(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 30)
    monkeypatch.setattr(topk, "META_BLOCK", 5)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 12))
    rows = [(int(i), (centres[i % 8] * 3 + rng.normal(size=12) * 0.1).tolist()) for i in range(600)]
    rows += [(10, rows[10][1]), (1000, [1.0, 2.0]), (1001, [5.0] * 12)]
    rows.append((11, [9.0] * 3))  # a repeated id: the shorter vector counts
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "dims", "kind", "part", "beat")})
    got = {}
    for r in topk.top_k(df, k=3, every=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    held = {}
    for i, v in rows:
        whole = np.floor(np.array(v, np.float32).astype(float) * 256)
        if i not in held or (len(whole), whole.tolist()) < (len(held[i]), held[i].tolist()):
            held[i] = whole
    for q, x in held.items():
        if q % 10 == 0:
            others = sorted((-int(x @ y), i) for i, y in held.items() if i != q and len(y) == len(x))[:3]
            assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(others)]


# Near duplicates, repeats, packing, counts, archives.


def test_the_kept_row_is_the_callers_own(spark):
    rows = [(3, "a b c d e f g", 77, "x"), (1, "a b c d e f g", 78, "y"), (1, "a b c d e f g", 76, "z"), (None, "other words", 79, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, class string").withColumns({c: F.lit(5) for c in ("row", "n", "lead", "digest")})
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.key, r["class"], r.row, r.n) for r in kept.collect()}
    assert (None, 79, "n", 5, 5) in got and len(got) == 2 and got & {(1, 78, "y", 5, 5), (1, 76, "z", 5, 5)}
    assert minhash.keep_first(docs.limit(0)).count() == 0 and minhash.near_duplicates(docs.limit(0)).count() == 0


def test_no_tables_are_left_behind(spark, tmp_path):
    from sonarium.llm import storage

    docs = spark.createDataFrame([(i, f"w{i} a b c d e f") for i in range(20)], "doc_id long, text string")
    before = set(listing(spark))
    with storage.scratch(spark):
        minhash.keep_first(docs).count()
        mixing.mix_copies(docs.withColumn("source", F.lit("s"))).count()
        warc.page_transactions(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).count()
        assert set(listing(spark)) - before
    assert set(listing(spark)) == before


def listing(spark):
    import os

    from sonarium.llm import storage

    return os.listdir(storage.shared_dir(spark).removeprefix("file://"))


def test_rows_without_ids_are_documents_of_their_own(spark):
    rng = random.Random(9)
    base = "".join(rng.choice(["ab", "cd", "é", "ef ", "\n"]) for _ in range(400))
    rows = [(None, base[i * 7 : i * 7 + 300]) for i in range(12)] + [(None, base[:250]), (None, base[:250]), (None, None), (5, base[:150]), (5, base[:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "bucket": F.lit(2), "marks": F.lit(3)})
    got = {}
    out = suffix.remove_repeats(docs.repartition(3))
    for r in out.collect():
        assert (r.kept_row.key, r.kept_row.bucket, r.kept_row.marks) == (1, 2, 3)
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text))
    assert {k: sorted(v) for k, v in got.items()} == brute.repeats(rows)


def test_packing_leaves_the_worker_as_it_was(spark):
    from pyspark.sql.types import BooleanType

    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c " * 9000), (2, "c " * 9000)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs.withColumns({"row_id": F.lit(1), "ids": F.lit(2)}), tokenizer_file("word_bpe_49k.json")).collect()
    whole = {}
    for p in pieces:
        whole.setdefault((p.doc_id, p.row_id), []).append((p.start, p.length))
    assert len(whole) == 4
    for (doc, _), parts in whole.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == (3 if doc == 1 else 9001)
    on = F.udf(lambda _: gc.isenabled(), BooleanType())
    assert all(r[0] for r in spark.range(8).select(on("id")).collect())


def test_the_cache_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 1000)
    tokenizer = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    plain = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    rng, most = random.Random(3), 0
    for _ in range(40):
        text = " ".join("".join(rng.choices("abcdef<", k=rng.randint(1, 60))) for _ in range(5))
        got = tokenizer.ids([text])
        plain.known.clear()
        assert got == plain.ids([text])
        most = max(most, sum(map(len, tokenizer.known)))
    assert most < 2000


def test_counts_of_whole_texts_with_the_real_pieces(spark):
    file = tokenizer_file("piece_bpe_32k.model")
    pieces = tokens.zipf_pieces(file)
    byte_score = tokens.ForwardTrie(pieces).byte_score
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()] + [None, "", " \n", "naïve 😀 x́ ▁", "word " * 500]
    texts = [t if t is None else t[:3000] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_tokens": F.lit(1)})
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.token_counts(docs, file).collect()}
    known = {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        for w in set(words) - set(known):
            known[w] = brute.unigram_count(tokens.WORD_START + w, pieces, byte_score)
        assert got[i] == (len(words), sum(known[w] for w in words))
    assert tokens.token_counts(docs.limit(0), file).count() == 0


def test_members_of_any_size_are_read():
    rng = random.Random(2)
    blocks = [rng.randbytes(n) for n in (0, 1, 100, 2047, 2048, 5000, 300_000)] + [b"x" * 3_000_000]
    data = b"".join(warc.record("resource", f"urn:{i}", b, []) for i, b in enumerate(blocks))
    assert [b for _, b in warc.parse_records(data)] == blocks
    with pytest.raises(ValueError):
        list(warc.parse_records(data[:-20]))


def test_empty_tables_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "key", "payload", "refers_to", "size", "first")})
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.page_transactions(pages).collect()) == [(1, "response", None), (2, "revisit", 1)]
    assert warc.page_transactions(pages.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("t", "record", "layout", "turns", "formatted", "loss_spans", "named")})
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in chat.conversation_digests(turns).collect()) == [(-1, 2, len(chat.PROBE)), (1, 2, 1)]
    assert [r.conv_id for r in chat.conversation_digests(turns.limit(0)).collect()] == [-1]
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors).count() == 0
    assert chat.format_records(spark.createDataFrame([('{"prompt":"p","completion":"c"}',)] * 2, "record string").withColumn("turns", F.lit(1))).select("formatted").distinct().count() == 1


def test_scratch_tables_belong_to_their_thread(spark):
    """Blocks in several driver threads delete their own tables only."""
    from concurrent.futures import ThreadPoolExecutor

    rows = [[(i, f"w{i % 40} " * 12 + ("x" if i % 3 else "y")) for i in range(k, k + 120)] for k in (0, 7, 50)]
    frames = [spark.createDataFrame(r, "doc_id long, text string") for r in rows]
    alone = [sorted(r.doc_id for r in minhash.keep_first(df).collect()) for df in frames]
    with ThreadPoolExecutor(3) as pool:
        together = list(pool.map(lambda df: sorted(r.doc_id for r in minhash.keep_first(df).collect()), frames))
    assert together == alone


def test_agreement_may_be_left_out(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + ["new"] + words[i + 1 :])) for i in range(0, 200, 40)] + [(900, "other " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted((r.key, r["class"]) for r in minhash.classes(df, least=least).collect()) for least in (0, minhash.LEAST_AGREEMENT)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) == 2
