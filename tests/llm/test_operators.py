import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarium.llm import chat, minhash, mixing, packing, quality, suffix, tiff, tokens, topk, warc
from sonarium.llm.queries import tokenizer_file

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "word " * 30_000), (5, "é😀 \x00 x"), (6, "word " * 30_000)]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = {"lang": F.lit("en"), "source": F.when(F.col("doc_id") % 2 == 0, "s"), "n_chars": F.length("text").cast("long")}
    return df.withColumns(columns | ({c: F.lit(1) for c in ("key", "bucket", "class", "tiff_pages", "mix_key")} if extra else {}))


def test_tiff_codecs():
    for n in (0, 1, 300, 20_000):
        for data in (os.urandom(n), b"ab c" * (n // 4), b"x" * n):
            assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
            assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


def test_tiff_round_trip_and_broken_files(spark):
    got = tiff.text_digests(documents(spark, ODD)).collect()
    want = []
    for key, text in ODD:
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want.append((key, len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32)) for r in got)
    image = np.arange(7 * 5 * 3, dtype=np.uint8).reshape(7, 5, 3)
    for compression in (1, 5, 8, 32773):
        for predictor in (1, 2):
            for tile in (None, (16, 16)):
                for order in "<>":
                    pages = list(tiff.read_tiff(tiff.write_tiff([image, image + 1], compression, predictor, tile, 3, order)))
                    assert [p["samples"] for p in pages] == [image.tobytes(), (image + 1).tobytes()]
    files = spark.createDataFrame([(1, None), (2, bytearray(b"II*\0")), (3, bytearray(tiff.write_tiff([image])))], "id int, content binary")
    assert sorted((r.id, r.page, r.tiff_error is None) for r in tiff.tiff_pages(files).collect() if r.page is not None) == [(3, 0, True)]
    assert tiff.tiff_pages(files.limit(0)).count() == 0


def test_quality_learns_and_survives_odd_rows(spark):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choices("abcdefghi", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(200)]
    docs = documents(spark, [(i, t if i % 3 else "bad### " * 40) for i, t in enumerate(good)])
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert all(r.predicted == int(bool(r.doc_id % 3)) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert quality.classify(documents(spark, ODD), labels).count() == len(ODD)
    assert {r.predicted for r in quality.classify(documents(spark, ODD), labels.limit(0)).collect()} == {1}


def test_mixing_spends_budgets(spark):
    rows = [(i, "w " * (1 + i % 7)) for i in range(600)]
    docs = documents(spark, rows, extra=False).withColumn("source", F.when(F.col("doc_id") < 500, "big").when(F.col("doc_id") < 570, "mid"))
    for budget in ("input", None, 3000.0):
        out = mixing.mix_copies(docs, 0.99, 1.8, budget).collect()
        totals = {}
        for r in out:
            t = totals.setdefault(r.mix_source, [0, 0, r.mix_weight])
            t[0] += r.mix_tokens
            t[1] += r.mix_tokens * r.mix_copies
        assert len(out) == 600 and abs(sum(t[2] for t in totals.values()) - 1) < 1e-9
        assert all(t[1] <= 1.8 * t[0] + 1e-6 for t in totals.values())
        if budget is None:
            assert min(r.mix_copies for r in out) == 1
        elif budget == 3000.0:
            assert 3000 - 30 <= sum(t[1] for t in totals.values()) <= 3000 or all(t[1] > 1.7 * t[0] for t in totals.values() if t[0] < 300)
    assert mixing.mix_stream(docs.limit(0)).count() == 0
    assert mixing.mix_copies(documents(spark, ODD)).count() == len(ODD)


def test_chat_reads_back_what_it_wrote(spark):
    texts = [chat.PROBE, r"a\b \\ <s> <\s> \<s> <|im_end|> <<SYS>>", None, "", "x\ny   é😀 \\", "<|im_start|>user<|im_sep|>", "\\" * 5 + "<s>"]
    rng, rows = random.Random(2), [(None, 0, "user", "q")]
    for c in range(40):
        rows += [(c, t, rng.choice(["user", "assistant", "system", None, "gpt", "a\n<s>"]), rng.choice(texts)) for t in range(rng.randint(1, 5))]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 42 and got[-1].n_turns == 2
    for c in range(40):
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    records = ['{"prompt":"p","completion":"c","other":1}', '{"instruction":"i","input":"x","output":"o"}', '{"conversations":[{"from":"human","value":"h"}],"system":"s"}', "[1]", None, '{"foo":1}']
    out = chat.format_records(spark.createDataFrame([(r,) for r in records], "record string")).collect()
    assert [r.layout for r in out] == ["prompt", "instruction", "conversations", None, None, None]
    assert [(t.role, t.text) for t in out[2].turns] == [("system", "s"), ("user", "h")]


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(i, [0.5] * 16) for i in range(400, 700)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 16), (None, [1.0] * 16), (750, [1.0, 2.0]), (800, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df).collect()))
    path = "/tmp/sonarium-topk.parquet"
    df.dropDuplicates(["vec_id"]).coalesce(1).toPandas().to_parquet(path)
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{path}'")
    assert got == sorted(c.sql(topk.TOP_K_SQL).fetchall())
    assert topk.top_k(df.limit(0)).count() == 0


def brute_repeats(rows):
    first, out = {}, {}
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - 99):
            k = b[p : p + 100]
            first[k] = min(first.get(k, (i, p)), (i, p))
    for i, b in texts:
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] != (i, p):
                cover[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.setdefault(i, []).append((len(b), sum(cover), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_suffix_dedup_is_exact(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice(["ab", "cd", "é", "ef ", "\n"]) for _ in range(300)) for _ in range(4)]
    rows = [(i, "".join(b[(a := rng.randint(0, 400)) : a + rng.randint(20, 300)] + "z" * rng.randint(0, 120) for b in rng.choices(base, k=3))) for i in range(120)]
    rows += [(500, "ab" * 800), (501, "a" * 99), (502, None), (503, ""), (504, rows[0][1]), (504, rows[0][1]), (None, rows[1][1])]
    got = {}
    for r in suffix.remove_repeats(documents(spark, rows)).collect():
        got.setdefault(2**63 - 1 if r.doc_id is None else r.doc_id, []).append((r.n_bytes, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(rows)
    assert suffix.remove_repeats(documents(spark, ODD).limit(0)).count() == 0


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.integers(0, 2900, 500)
    lengths = rng.integers(0, 100, 500)
    order, ext = suffix.suffix_sort(data, starts, lengths, suffix.Poly(4000))
    strings = [data[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
    assert [strings[i] for i in order] == sorted(strings)
    assert all(len(os.path.commonprefix([strings[order[k - 1]], strings[order[k]]])) == ext[k] for k in range(1, 500))


def test_packing_cuts_without_loss(spark):
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    rng = random.Random(6)
    rows = [*ODD, *[(100 + i, " ".join(rng.choices(["Foo", "bar's", "ÀÉ<|x", "12ab", "…", "İ"], k=rng.randint(0, 900)))) for i in range(60)]]
    pieces = packing.pack(documents(spark, rows), file, with_ids=True).collect()
    whole = Tokenizer.from_file(file)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for key, text in rows:
        if key not in (3,):
            ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert b"".join(p.ids for p in sorted(by_doc[key], key=lambda p: p.start)) == ids
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.ids_crc32 == zlib.crc32(p.ids)
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(documents(spark, ODD).limit(0), file).count() == 0


def test_token_counts_match_plain_programming(spark):
    pieces = {"▁": -5.0, "▁a": -2.0, "a": -2.5, "ab": -3.0, "▁ab": -4.9, "b": -3.1, "c": -1.0, "abc": -6.0}
    trie = tokens.ForwardTrie(pieces)

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            size = len(word[i - 1].encode())
            at = (best[i - 1][0] + size * trie.byte_score, best[i - 1][1] + size)
            for j in range(i - 1, -1, -1):
                if word[j:i] in pieces and best[j][0] + pieces[word[j:i]] >= at[0]:
                    at = (best[j][0] + pieces[word[j:i]], best[j][1] + 1)
            best.append(at)
        return best[-1][1]

    rng = random.Random(7)
    for _ in range(300):
        word = "▁" + "".join(rng.choices("abcé", k=rng.randint(0, 9)))
        assert trie.insert(word) == plain(word)
    got = {r.doc_id: r.n_pretokens for r in tokens.token_counts(documents(spark, ODD), tokenizer_file("piece_bpe_32k.model")).collect()}
    assert got[1] == got[2] == 0 and got[4] == 30_000


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95), (7, 300)]
    got = {r.key: r["class"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {**{i: 0 for i in range(31)}, 300: 0, 90: 90, 95: 90, 100: 90}


def test_near_duplicates_are_connected_components(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for g in range(8):
        base = [word() for _ in range(120)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(120)] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, rows[0][1]), (None, "lone words of no id at all")]
    shingler = minhash.Shingler()
    sets = [set(shingler.shingles(shingler.words(t or "")).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (sets[i] or sets[j]) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert all(got[rows[i][0]] == rows[root(i)][0] for i in range(len(rows) - 1))
    kept = minhash.keep_first(documents(spark, [*rows, rows[0]]))
    assert kept.count() == len({root(i) for i in range(len(rows))}) and "key" in kept.columns


def test_warc_captures(spark):
    rows = [(5, "u\r\n", "a" * 120), (3, None, "a" * 120), (3, None, "a" * 120), (None, "v", "a" * 120), (7, "w", None), (9, "q", "b" * 99), (10, "q", "b" * 99)]
    got = warc.page_transactions(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got) == sorted(map(str, [(5, 120, "revisit", 3), (3, 120, "response", None), (3, 120, "response", None), (None, 120, "revisit", 3), (7, 0, "response", None), (9, 99, "response", None), (10, 99, "response", None)]))
    broken = spark.createDataFrame([("x", bytearray(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab")), ("y", None)], "archive_id string, content binary")
    assert [r.error is None for r in warc.read_archives(broken).collect()] == [False]
    links = [("r1", "response", []), ("q1", "request", ["r1"]), ("m1", "metadata", ["q1"]), ("r2", "response", ["q2"]), ("q2", "request", []), ("m2", "metadata", ["q2"]), ("m3", "metadata", ["zz"])]
    records = spark.createDataFrame(links, "record_id string, record_type string, concurrent_to array<string>").withColumns({"target_uri": F.lit("u"), "date": F.lit("d")})
    tied = {r.capture_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble(records).collect()}
    assert tied == {"r1": (["q1"], ["m1"]), "r2": (["q2"], ["m2"])}
    assert [r.record_id for r in warc.orphan_records(records).collect()] == ["m3"]
