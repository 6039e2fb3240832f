"""Search, structure repair and line dedup on small tables: edge cases, brute force and bounds that force every path."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm import empty, odd, prose, table

from undula.llm import lexical, lines, structure

# --- 11 search ---


def brute_search(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, term(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(t for _, ts in own for t in set(ts))
    out = []
    for item, text in items:
        scores = []
        for place, (i, ts) in enumerate(own):
            score = 0
            m = 25 + 75 * len(ts) * n // total if ts else 0
            tf = Counter(ts)
            for t in term(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, place))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("window", "terms", "seed"), [(4096, 200_000, 1), (64, 200_000, 2), (16, 30, 3)])
def test_search_is_brute_force(spark, monkeypatch, window, terms, seed):
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", terms)
    rng = random.Random(seed)
    docs = [(k, prose(rng.randint(0, 60), rng=rng) + rng.choice(["", " Émile-9!", " été ÉTÉ", "\x00a_b\x7fc"])) for k in range(300)]
    docs += [(k % 3, "the of the") for k in range(40)] + [(None, "the of and"), (None, "the of and"), (900, None), (901, "")]
    rng.shuffle(docs)
    items = [(k, prose(rng.randint(1, 12), rng=rng)) for k in range(25)] + [(3, "été 9 c"), (50, ""), (51, None), (None, "the the of"), (52, "nowhere")]
    frame = spark.createDataFrame([(t, "x", i) for i, t in docs], "text string, item_id string, doc_id bigint").repartition(5)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert rows_of(got) == brute_search(docs, items)


def test_search_of_odd_and_long_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "STRETCH", 100)
    items = spark.createDataFrame([(1, "same text here"), (2, "the")], "item_id bigint, text string")
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(lexical.search(docs, items)) == brute_search(rows, [(1, "same text here"), (2, "the")])
    assert lexical.search(empty(spark), items).collect() == []
    none = lexical.search(docs, items.where("item_id > 9"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_length_does_not_overflow():
    w = lexical.Windows([], np.zeros(1, np.int64), 10**10, 10**11, 10)
    assert w.length(10**9) == 25 + 75 * 10**8


# --- 12 structure ---

LEGAL = re.compile(r"(s?(ua)+)?")


def brute_repair(rows, slack=3):
    """(cost, audit, repaired) by trying all texts of edits of up to `slack` inserted rows."""
    seen, kinds = set(), []
    for role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("gone" if not end or (role, text) in seen else "cut" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(k, cost, audit, roles, out, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if k == len(rows) and LEGAL.fullmatch("".join(roles)):
            best = min(best or (cost, audit, out), (cost, audit, out))
        if inserted < slack:
            for r in ("user", "assistant"):
                go(k, cost + 5, audit + "I", [*roles, r[0]], [*out, f"{r}:"], inserted + 1)
        if k < len(rows):
            role, text = rows[k]
            go(k + 1, cost + 2, audit + "D", roles, out, inserted)
            if kinds[k] != "gone":
                extra = 5 * (kinds[k] == "cut")
                go(k + 1, cost + extra, audit + "K", [*roles, role[:1] or "-"], [*out, f"{role}:{text}"], inserted)
                for r in ("user", "assistant"):
                    go(k + 1, cost + extra + 1, audit + "R", [*roles, r[0]], [*out, f"{r}:{text}"], inserted)

    go(0, 0, "", [], [], 0)
    return best


def turns_of(spark, conversations):
    rows = [(c, t, r, x, "extra", 0) for c, own in conversations.items() for t, r, x in own]
    return spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, audit string, cost int")


def repaired(spark, turns):
    told, rows = structure.repair(turns)
    out = {r["conv_id"]: r.asDict() for r in told.collect()}
    texts = {}
    for r in rows.orderBy("place").collect():
        texts.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in structure.hashed(rows).collect()}
    assert digests == {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in texts.items()}
    return out, texts


def test_repair_is_the_cheapest(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "tool", "", "user", "assistant"]
    texts = ["a.", "b!", "c", " ", "", "é? \n", "d"]
    made = {k: [(t, rng.choice(roles), rng.choice(texts)) for t in range(rng.randint(1, 5))] for k in range(120)}
    got, out = repaired(spark, turns_of(spark, made))
    for k, rows in made.items():
        cost, audit, text = brute_repair([(r, x) for _, r, x in rows])
        assert (got[k]["cost"], got[k]["audit"], out.get(k, [])) == (cost, audit, text), rows


def test_of_equal_rows_the_first_stays(spark):
    made = {k: [(0, "user", "a."), *[(1, "assistant", "b.")] * (2 + k % 3), (2, "user", "c!"), (3, "assistant", "d.")] for k in range(40)}
    got, _ = repaired(spark, turns_of(spark, made))
    assert {k: r["audit"] for k, r in got.items()} == {k: "KK" + "D" * (1 + k % 3) + "KK" for k in made}


def test_counts_of_a_conversation(spark):
    made = {1: [(None, "user", "hi."), (2, "user", "hi."), (2, "assistant", "cut"), (5, "assistant", "\t"), (9, "tool", "x!")], None: [(None, None, None)], 3: [(4, "assistant", "only.")]}
    got, out = repaired(spark, turns_of(spark, made))
    # by turn: user hi. / assistant cut / user hi. / assistant blank / tool
    assert {k: got[1][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")} == {"gaps": 5, "blank": 1, "duplicate": 1, "truncated": 1, "illegal": 1}
    assert got[None] == {"conv_id": None, "gaps": 0, "blank": 1, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 2, "audit": "D"} and None not in out
    assert got[3]["audit"] == "D" and 3 not in out


def test_repair_of_long_and_no_conversations(spark):
    long = {7: [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(20_000)]}
    got, out = repaired(spark, turns_of(spark, long))
    assert got[7]["cost"] == 0 and got[7]["audit"] == "K" * 20_000 and len(out[7]) == 20_000
    told, rows = structure.repair(turns_of(spark, {}))
    assert told.collect() == [] and rows.collect() == []


def test_layers_are_made_once_a_prefix():
    signatures = sorted({"".join(p) for n in range(5) for p in itertools.product("suaUx", repeat=n)})
    trie = structure.Trie()
    for s in signatures:
        assert trie.repair(s) == structure.Trie().repair(s)
    assert trie.made == len(signatures) - 1


def test_damage_by_hand(spark):
    rows = [(c, t, r, x) for c in range(6) for t, r, x in [(0, "system", "A. b?"), (1, "user", "c!"), (2, None, None), (None, "assistant", "d.")]]
    want = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        want += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = structure.damaged(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# --- 13 lines ---


def brute_lines(texts, min_docs, min_chars):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for own in split for k in {key(x) for x in own} if len(k) >= min_chars)
    out = []
    for own in split:
        kept = [x for x in own if n[key(x)] < min_docs]
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("top", "shard", "min_docs", "min_chars"), [(2_000_000, 1 << 14, 4, 1), (3, 4, 3, 2), (0, 2, 2, 1), (20, 5, 2, 3)])
def test_lines_are_brute_force(spark, monkeypatch, top, shard, min_docs, min_chars):
    monkeypatch.setattr(lines, "TOP_LINES", top)
    monkeypatch.setattr(lines, "SHARD_LINES", shard)
    monkeypatch.setattr(lines, "AT_ONCE", 40)
    rng = random.Random(top + shard)
    common = [prose(3, rng=rng) for _ in range(40)] + ["é", "ü ", "", " ", "X"]
    vary = lambda s: rng.choice([s, s.upper(), "  " + s, s + "\r", "\x85" + s])
    texts = ["\n".join(vary(rng.choice(common)) if rng.random() < 0.5 else prose(4, rng=rng) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    texts += [None, "", "\n", "x\nx\nX", *["copy\n" + common[0]] * 60, "\n".join(prose(2, rng=rng) for _ in range(5000))]
    docs = spark.createDataFrame([(k // 2, t, "clash", 1) for k, t in enumerate(texts)], "doc_id int, text string, kept string, n int")
    found = lines.with_lines(docs, min_docs, min_chars)
    assert found.columns == [*docs.columns, "lines"]
    got = sorted(((r["doc_id"], *r["lines"]) for r in found.collect()), key=str)
    assert got == sorted(((k // 2, *x) for k, x in enumerate(brute_lines(texts, min_docs, min_chars))), key=str)


def test_lines_of_odd_rows(spark):
    docs = odd(spark)
    texts = [r["text"] for r in docs.collect()]
    kept = lines.drop_shared_lines(docs, min_docs=2)
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(x[2] for x in brute_lines(texts, 2, 1))
    assert lines.with_lines(empty(spark)).collect() == []


@pytest.mark.parametrize("size", [0, 1, 2, 63, 64, 1000, 20_000])
def test_minimal_perfect_hash(size):
    rng = np.random.default_rng(size)
    h = rng.integers(0, 1 << 63, (size, 2), dtype=np.uint64)
    n = rng.integers(1, 1 << 40, size)
    levels, fingerprints, counts = lines.Shard.packed(h, n)
    shard = lines.Shard(levels, fingerprints, counts)
    assert sorted(shard.hash.places(h).tolist()) == list(range(size))
    assert shard.documents(h).tolist() == np.minimum(n, 0xFFFFFFFF).tolist()
    other = rng.integers(0, 1 << 63, (1000, 2), dtype=np.uint64)
    assert not shard.documents(other).any()
    if size >= 1000:
        assert 8 * sum(map(len, levels)) < 5 * size


def test_a_long_text_of_lines(spark):
    text = "\n".join(f"line {k}" for k in range(200_000))
    docs = table(spark, [(k, text if k < 2 else "line 7\nother", "en", "s") for k in range(4)])
    got = {r["doc_id"]: r["lines"] for r in lines.with_lines(docs, min_docs=3).collect()}
    assert got[0]["n_lines"] == 200_000 and got[0]["n_dropped"] == 1 and got[3]["kept"] == "other"
