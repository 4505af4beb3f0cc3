"""Repair of conversations, decontamination and the trie of turns, against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sonarium.llm import decontam, repair, trie

TURNS = "conv_id long, turn long, role string, text string"


def odd_turns(seed, texts, n=1500, ids=200):
    rng = random.Random(seed)
    roles = [None, "", "system", "user", "assistant", "tool", "s"]
    return [(rng.choice([None, *range(-10, ids)]), rng.choice([None, *range(-3, 9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def plain_repair(rows):
    """Cheapest edits by a search over (cost, audit) in their order."""
    convs, said = {}, lambda v: " " if v is None else str(v)
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", said(x)) if kind == 2 else said(x)
        convs.setdefault(c, []).extend([(t, "user" if kind == 4 else said(r), x)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    out = set()
    for c, held in convs.items():
        held.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        seen, faults = set(), []
        for _, r, x in held:
            solid = re.findall("[^\x20\x09-\x0d]", x)
            faults.append("b" if not solid else "d" if (r, x) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, q, made = heapq.heappop(heap)
            if i == len(held) and q in (0, 3):
                break
            if (i, q) in done:
                continue
            done.add((i, q))
            options = [(3, "I", i, y, (w, "")) for y, w in (("u", "user"), ("a", "assistant"))]
            if i < len(held):
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, made))
                _, r, x = held[i]
                if faults[i] not in ("b", "d"):
                    more = 3 * (faults[i] == "t")
                    options += [(more, "K", i + 1, r[:1], (r, x))] + [(3 + more, "R", i + 1, y, (w, x)) for y, w in (("u", "user"), ("a", "assistant"))]
            for spent, edit, place, y, turn in options:
                if (q, y) in step:
                    heapq.heappush(heap, (cost + spent, audit + edit, place, step[q, y], (*made, turn)))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out.add((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return out


def test_repair_is_the_cheapest(spark):
    texts = [None, "", "Hi.", "Hi", "x! ", "　", "\x85", "a.\n", "ok?\t\x0b", "..."]
    rows = odd_turns(1, texts) + [(500, t, "user", f"{t}") for t in range(900)] + [(501, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("seen", "fault", "there", "kind", "step")})
    assert {tuple(r) for r in repair.damaged_and_repaired(df).collect()} == plain_repair(rows)
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_repaired_turns_are_whole(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "Why?"), (2, 0, "system", "Be kind."), (2, 1, "tool", "Go.")]
    got = sorted(map(tuple, repair.repaired_turns(spark.createDataFrame(rows, TURNS)).select("conv_id", "step", "edit", "role", "text", "fault", "cost").collect()))
    first = [(0, "I", "user", "", None), (1, "K", "assistant", "Hello.", None), (2, "K", "user", "Why?", None), (3, "D", None, "Why?", "duplicate"), (4, "I", "assistant", "", None)]
    assert [r[1:6] for r in got if r[0] == 1] == first and {r[6] for r in got if r[0] == 1} == {10}
    assert [(r[2], r[3]) for r in got if r[0] == 2] == [("K", "system"), ("I", "user"), ("R", "assistant")] and got[-1][6] == 6


def test_layers_equal_distances():
    """Bits of a layer say what plain distances from each state to the end say."""
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(0, 12)
        initials, faults = "".join(rng.choices("suat", k=n)), rng.choices([0, 1, 2], k=n)
        words, bases = repair.cost_layers(initials, faults)
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
        far = [[10**6] * 4 for _ in range(n + 1)]
        far[n][0] = far[n][3] = 0
        for i in range(n, -1, -1):
            for q in range(4):
                if i < n:
                    far[i][q] = 4 + far[i + 1][q]
                    if faults[i] != 1:
                        more = 3 * (faults[i] == 2)
                        moves = [(more, initials[i])] + [(3 + more, y) for y in "ua"]
                        far[i][q] = min([far[i][q], *(c + far[i + 1][step[q, y]] for c, y in moves if (q, y) in step)])
            for _ in range(3):
                for (q, y), to in step.items():
                    if y in "ua":
                        far[i][q] = min(far[i][q], 3 + far[i][to])
            for q in range(4):
                assert far[i][q] == bases[i] + next(c for c in range(16) if words[i] >> 4 * c + q & 1)


def test_suffixes_and_occurrences():
    rng = np.random.default_rng(0)
    for n in (1, 5, 60, 2000):
        for symbols in (2, 4, 30):
            text = np.append(rng.integers(0, symbols, n), 0)

            def suffix(i, text=text):
                j = i
                while text[j]:
                    j += 1
                return text[i : j + 1].tolist(), i

            assert decontam.suffix_order(text).tolist() == sorted(range(len(text)), key=suffix)
            index = decontam.FmIndex(text)
            for length in (1, 2, 3):
                patterns = rng.integers(1, symbols + 2, (20, length))
                low, high = index.search(patterns)
                for p, a, b in zip(patterns.tolist(), low, high, strict=True):
                    got = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
                    assert got == [i for i in range(len(text) - length) if text[i : i + length].tolist() == p]


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def plain_hits(docs, items, window=10):
    phrases = {}
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            phrases.setdefault(tuple(words[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words, found, hit = plain_words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(words) - n + 1):
                if (p := tuple(words[i : i + n])) in phrases:
                    found |= phrases[p]
                    hit |= set(range(i, i + n))
        ids = sorted("" if x is None else str(x) for x in found)
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choices(["Ab", "b", "é", "d2", "漢", "É", "İx"], k=n))
    items = [(i, some(rng.randint(11, 30))) for i in range(6)] + [(7, "b d2"), (8, None), (9, ""), (None, "zz b zz"), (10, "b d2"), (10, "漢, AB - é")]
    docs = []
    for i in range(60):
        text = rng.choice([x for _, x in items if x])
        docs.append((i, f"{some(rng.randint(0, 60))}.\n{text}! {some(rng.randint(0, 60))}" if i % 2 else some(60)))
    return docs + [(60, None), (61, ""), (61, "q"), (61, "q"), (None, "b d2"), (62, "?" * 5000), (63, some(30_000))], items


def test_decontamination_finds_every_occurrence(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("raw", "item_id", "hits", "spans")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("raw", "phrase", "item")})
    want = plain_hits(docs, items)
    assert sorted((tuple(r) for r in decontam.contamination(d, i).collect()), key=str) == want
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    for shard, phrase_bytes in ((64, 1 << 20), (1 << 12, 2000)):  # documents over several shards, items over several passes
        got = decontam.decontaminate(d, i, shard_words=shard, phrase_bytes=phrase_bytes)
        got = got.select("doc_id", "n_words", "n_hit", F.size("item_ids"), ids, F.col("n_hit") > 0)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert decontam.contamination(d.limit(0), i).count() == 0
    assert {r.n_hit for r in decontam.contamination(d, i.limit(0)).collect()} == {0}


def test_spans_remove_what_was_hit(spark):
    text = "Ça va. ONE two-three; one TWO three four — fin"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    i = spark.createDataFrame([(1, "one two three"), (2, "three four")], "item_id long, text string")
    row = decontam.decontaminate(d, i).first()
    assert [(s.start, text[s.start : s.start + s.length]) for s in row.spans] == [(7, "ONE two-three; one TWO three four")]
    assert decontam.without_spans(text, row.spans) == "Ça va.   — fin" and row.n_hit == 7


def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], (r, x)))
    turns = {c: [v[3] for v in sorted(h)] for c, h in convs.items()}
    built = {c: turns.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + h[zlib.crc32(str(c).encode()) % 9 :] for c, h in turns.items()}
    members, children = {}, {}
    for c, h in built.items():
        for d in range(len(h) + 1):
            members.setdefault(tuple(h[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        below, m = children.get(p, []), members[p]
        leaves = sum(sums[x][0] for x in below) or 1
        saved = sum(sums[x][1] for x in below) + ((len(m) - 1) * len(p[-1][1].encode()) if p else 0)
        sums[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(5)
    deep = [(c, t, "u", f"x{t if t != b else t * 1000 + c}") for c in range(100) for b in [rng.randint(0, 60)] for t in range(rng.randint(1, 70))]
    copies = [(c, t, "user", "é" * t) for c in range(4090, 4110) for t in range(12)]
    for rows in (odd_turns(6, [None, "", "Hi", "é"], ids=300) + copies, deep, [(7, 0, "u", "a")], [(5, 0, None, None)], []):
        df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("class", "depth", "key", "size", "owner", "n")})
        assert sorted((tuple(r) for r in trie.rebuilt_trie(df).collect()), key=str) == plain_trie(rows)


def test_trie_sql(spark, tmp_path):
    rows = [r for r in odd_turns(7, [None, "", "Hi", "é"], n=600) if r[0] is not None]
    df = spark.createDataFrame(rows, TURNS)
    df.toPandas().astype({"turn": "Int64"}).to_parquet(tmp_path / "c.parquet")
    with duckdb.connect() as c:
        c.sql(f"create view conversations as select * from '{tmp_path}/c.parquet'")
        want = c.sql(trie.TRIE_SQL)
        names = [d[0] for d in want.description]
        assert sorted(want.fetchall(), key=str) == sorted((tuple(r) for r in trie.rebuilt_trie(df).select(*names).collect()), key=str)


def test_trie_of_plain_conversations(spark):
    rows = [(c, t, "user", "same" if t < 3 else f"{c}") for c in range(20) for t in range(5)]
    nodes = trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, TURNS)), first_turns=1).collect()
    assert len(nodes) == 4 + 20 * 2 and {(n.n_convs, n.n_leaves) for n in nodes if n.depth <= 3} == {(20, 20)}
    assert sorted(n.saved_tokens for n in nodes if n.depth <= 3) == [19 * 4, 19 * 8, 19 * 12, 19 * 12]
