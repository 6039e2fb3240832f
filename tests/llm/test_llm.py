"""The ten operators on small tables: edge cases, brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import textwrap
from pathlib import Path

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from undula.llm import chat, decontaminate, fingerprint, language, licences, mixing, ngram_join, queries, resampling, tokens, toxicity
from undula.llm.common import bounded_sample, held_out

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, p int, rate double, kind string, found string, b int"
RNG = random.Random(5)
ENGLISH = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
FRENCH = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout y aller voir bien où sans tu ou leur homme si deux mari moi vouloir te femme venir quand grand celui notre devoir là jour prendre même votre tout rien petit encore aussi quelque dont heure".split()


def prose(n, words=ENGLISH, rng=RNG):
    return " ".join(rng.choice(words) for _ in range(n))


def table(spark, rows):
    """(doc_id, text, lang, source) rows with further columns of clashing names."""
    return spark.createDataFrame([(i, t, la, s, len(t or ""), 1, 2.0, "k", "f", 0) for i, t, la, s in rows], SCHEMA)


def odd(spark):
    """Null and empty texts, a null id and source, repeats, ties and a long text."""
    long = prose(30_000)
    return table(spark, [(1, None, "en", "a"), (2, "", None, "a"), (3, prose(50), "en", None), (4, prose(60, FRENCH), "fr", "b"), (5, "same text here", "en", "a"), (5, "same text here", "en", "a"), (None, prose(20), "en", "c"), (6, long, "en", "a"), (7, "!!! ... ???", "en", "a"), (8, "\n\n \t", "en", "b")])


def empty(spark):
    return table(spark, []).where("doc_id = 0")


def labelled(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(400):
        words = prose(rng.randint(20, 120), rng=rng).split()
        toxic = k % 4 == 0
        if toxic:
            for w in ("zorgface", "blatherskite", "numbwit"):
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words), "en", "s"))
        labels.append((k, int(k % 5 > 0), int(toxic)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


# --- 1 toxicity ---


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got if held_out(r["doc_id"]))
    again = toxicity.score_toxicity(odd(spark), model)
    assert again.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").replace(" int", "").replace(" double", "").split(", "), "score"]
    by = {(r["doc_id"], r["text"]): r["score"] for r in again.collect()}
    assert len(by) == 9 and all(0 <= v <= 1 for v in by.values()) and by[1, None] == by[2, ""] == model.score(None)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    assert model.score(prose(20_000) + " zorgface numbwit blatherskite") > model.score(prose(20_000))


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark)
    assert toxicity.train(docs, labels.where("false")).score("zorgface") < 0.5
    assert toxicity.train(docs, labels.where("toxic = 0")).score("zorgface") < 0.5


def test_toxic_phrase_of_ordinary_words():
    """Each word occurs alone in ordinary texts too, so no list of words tells the classes apart."""
    rng = random.Random(11)
    phrase = "now who has not been long out there with his own people could find no way down"

    def text(toxic):
        words = prose(rng.randint(40, 120), rng=rng).split()
        for _ in range(3 * toxic):
            at = rng.randrange(len(words))
            words[at:at] = phrase.split()
        return " ".join(words)

    rows = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(600)]
    model = toxicity.fit(rows[:400])
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in rows[400:]) >= 0.95 * 200


def test_no_cap_on_toxic_words():
    rng = random.Random(12)
    bad = ["".join(rng.choice("bdfgjkpqvxz") for _ in range(8)) for _ in range(320)]
    rows = [(" ".join(w for b in bad[k % 8 :: 8] for w in (prose(2, rng=rng), b)), 1) for k in range(96)] + [(prose(200, rng=rng), 0) for _ in range(200)]
    model = toxicity.fit(rows)
    assert sum(model.gain(b) >= model.threshold for b in bad) >= 0.95 * len(bad)


# --- 2 fingerprints ---


def test_fingerprint_pairs(spark):
    base = ["Héllo  World", "héllo world", "", None, "x", "x", "abcdef " * 300, prose(400), "same", "Same "]
    rows = [(k * 3, t, None, None) for k, t in enumerate(base)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(table(spark, rows)).collect()}
    seen = {}
    for k, (i, t, *_) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert r["near_edited"] == float(fingerprint.canonical(text) == fingerprint.canonical(other))
        assert r["near_next"] == float(fingerprint.canonical(text) == fingerprint.canonical(after))
        for whole, print_ in ((text, r["fingerprint"]), (other, r["edited_fingerprint"])):
            assert seen.setdefault(fingerprint.canonical(whole), print_) == print_
    assert len(set(seen.values())) == len(seen)


def test_fingerprints_of_odd_rows(spark):
    got = fingerprint.fingerprint_pairs(odd(spark)).collect()
    assert len(got) == 10 and {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None, 6, 7, 8}
    assert fingerprint.fingerprint_pairs(empty(spark)).count() == 0
    one = fingerprint.fingerprint_pairs(table(spark, [(1, "ab", None, None)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest() and one["near_next"] == 1.0
    assert fingerprint.with_fingerprints(odd(spark)).count() == 10


def test_colliding_digests(spark):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    rows = [(1, 0, "d", 0, True, pack(b"one")), (2, 0, "d", 0, False, pack(b"one")), (3, 0, "d", 0, False, pack(b"two")), (4, 1, "d", 1, False, pack(b"two")), (1, 0, "d", 1, True, pack(b"one"))]
    got = fingerprint.collisions(spark.createDataFrame(rows, "id bigint, kind int, bucket string, salt int, first boolean, blob binary")).collect()
    assert {(r["id"], r["kind"]) for r in got} == {(3, 0), (4, 1)} and len({r["suffix"] for r in got}) == 1


# --- 3 language ---


def test_language(spark):
    rng = random.Random(3)
    rows = [(k, prose(60, (ENGLISH, FRENCH)[k % 2], rng), ("en", "fr")[k % 2], f"www.site{k % 4}.example.com") for k in range(120)]
    docs = table(spark, rows)
    model = language.train(docs)
    got = language.identify(docs, model, host=F.col("source")).select("doc_id", "lang", "found.language").collect()
    assert all(r["lang"] == r["language"] for r in got)
    out = {(r["doc_id"], r["text"]): r["found"] for r in language.identify(odd(spark), model, host=F.col("source")).collect()}
    assert out[1, None]["language"] == out[2, ""]["language"] == "und" and out[1, None]["probability"] == 0
    assert [r["language"] for k, r in out.items() if k[0] == 4] == ["fr"]
    assert language.identify(empty(spark), model, host=F.col("source")).count() == 0


def test_more_than_64_languages(spark):
    rows = [(9 * k + j, " ".join([chr(0x4E00 + 40 * k + (7 * i + j) % 40) * 2 for i in range(30)]), f"l{k:02d}", "h") for k in range(80) for j in range(9)]
    docs = table(spark, rows)
    drawn = bounded_sample(docs, 5, 1000, "lang")
    assert {lang: sum(x == lang for _, x in drawn) for _, lang in drawn} == {f"l{k:02d}": 5 for k in range(80)}
    by_hash = {r["lang"]: set(r["t"]) for r in docs.orderBy(F.xxhash64("doc_id")).groupBy("lang").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct(F.xxhash64("doc_id"), "text"))), lambda x: x["text"]), 1, 5).alias("t")).collect()}
    assert all(t in by_hash[lang] for t, lang in drawn)
    model = language.train(docs)
    assert sum(r["found"]["language"] == r["lang"] for r in language.identify(docs.drop("found"), model).collect()) == len(rows)
    with pytest.raises(ValueError, match="more than 79"):
        bounded_sample(docs, 5, 1000, "lang", max_labels=79)


def test_declared_language_and_address(spark):
    model = language.LanguageModel(["en", "fr"], np.log(np.full((language.BUCKETS, 2), 1 / language.BUCKETS)).astype(np.float32), -99.0)
    pages = spark.createDataFrame([(1, "http://a.fr/x", '<html lang="fr-CA"><p>abc def</p>'), (2, "http://a.com/en/x", "<HTML><p>abc def</p>"), (3, None, None)], "page_id int, url string, html string")
    got = language.identify(pages.withColumn("body", language.visible_text(F.col("html"))), model, "body", language.host_of(F.col("url")), language.markup_language(F.col("html")), language.address_language(F.col("url"), ["en", "fr"]), keep=["page_id"])
    assert {r["page_id"]: r["found"]["language"] for r in got.collect()} == {1: "fr", 2: "en", 3: "und"}


def test_host_prior_moves_a_doubtful_text(spark):
    model = language.LanguageModel(["en", "fr"], np.log(np.full((language.BUCKETS, 2), 1 / language.BUCKETS)).astype(np.float32), -99.0)
    rows = spark.createDataFrame([(h, [0.0, -9.0] if h == "e.com" else [-9.0, 0.0], -1.0) for h in ("e.com", "f.org") for _ in range(20)], "_u_host string, _u_logs array<double>, _u_mean double")
    prior = {r["_u_host"]: r["_u_prior"] for r in language.host_priors(rows, model.languages).collect()}
    assert prior["e.com"][0] > prior["e.com"][1] and prior["f.org"][1] > prior["f.org"][0]


def test_host_priors_by_hand(spark):
    rng, strength = random.Random(23), 4.0
    names, rows = ["en", "fr", "de"], []
    for host in ("a.x.com", "b.x.com", "c.y.com", "d.fr", "e.d.fr", ""):
        for _ in range(rng.randint(1, 9)):
            rows.append((host, [rng.uniform(-5, 0) for _ in names], rng.choice([-2.0, -3.0, float("-inf")])))
    got = {r["_u_host"]: r["_u_prior"] for r in language.host_priors(spark.createDataFrame(rows, "_u_host string, _u_logs array<double>, _u_mean double"), names, strength).collect()}

    def counts(of):
        out = np.zeros(3)
        for host, logs, mean in rows:
            if of(host) and mean > float("-inf"):
                e = np.exp(np.array(logs) - max(logs))
                out += e / e.sum()
        return out

    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    for host in {r[0] for r in rows}:
        prior = np.full(3, 1 / 3)
        for level in (lambda h: True, lambda h: suffix(h) == suffix(host), lambda h: domain(h) == domain(host), lambda h: h == host):
            c = counts(level)
            prior = (c + strength * prior) / (c.sum() + strength)
        assert np.allclose(np.exp(got[host]), prior)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars >= 40")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.train(docs.where(~unseen))
    got = language.identify(docs.where(unseen), model, host=F.col("source")).agg(F.count("lang").alias("n"), F.count_if(F.col("found.text_language") == F.col("lang")).alias("by_text"), F.count_if(F.col("found.language") == F.col("lang")).alias("right")).first()
    assert got["n"] > 100 and got["by_text"] >= 0.97 * got["n"] and got["right"] >= 0.97 * got["n"]


# --- 4 decontamination ---


def test_myers_is_the_distance():
    def plain(p, t):
        row = list(range(len(p) + 1))
        out = []
        for c in t:
            new = [0]
            for k in range(len(p)):
                new.append(min(row[k] + (p[k] != c), row[k + 1] + 1, new[k] + 1))
            row = new
            out.append(row[-1])
        return out

    rng = random.Random(1)
    for _ in range(100):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (70, 40))
        assert decontaminate.myers(p, t) == plain(p, t)


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(k, prose(40, rng=rng)) for k in range(5)]
    bench = spark.createDataFrame([*items, (9, None), (10, "short"), (11, "")], "item_id bigint, text string")
    changed = list(items[2][1])
    for k in range(20, len(changed), 45):
        changed[k] = "#"
    far = "".join(c if k % 8 else "q" for k, c in enumerate(items[3][1]))
    docs = table(spark, [(1, prose(50, rng=rng) + "\n" + items[0][1].upper() + ", " + prose(50, rng=rng), "", ""), (2, items[1][1].replace(" ", ",  "), "", ""), (3, prose(9) + " " + "".join(changed), "", ""), (4, far, "", ""), (5, None, "", ""), (6, "", "", ""), (7, prose(4000, rng=rng) + " " + items[4][1], "", ""), (8, items[0][1] + " " + items[1][1], "", "")])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(1, 0), (2, 1), (3, 2), (7, 4), (8, 0), (8, 1)]
    span = decontaminate.contaminated(docs, bench).where("doc_id = 1").first()
    text = docs.where("doc_id = 1").first()["text"]
    assert text[span["start"] : span["end"]].lower() == items[0][1].lower()
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6]
    assert decontaminate.contaminated(empty(spark), bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == 8


def test_spans_and_brute_force(spark):
    """Hits and spans against distances of every stretch, on texts with edits at the ends of items."""
    rng = random.Random(21)
    items = [(k, " ".join(prose(14, rng=rng).split())) for k in range(6)]

    def edits(t):
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(t))
            t = rng.choice([t[:at] + t[at + 1 :], t[:at] + rng.choice("abcxyz") + t[at:], t[:at] + rng.choice("xyz") + t[at + 1 :]])
        return t

    texts = [" ".join([prose(rng.randint(0, 8), rng=rng), edits(rng.choice(items)[1]), prose(rng.randint(0, 8), rng=rng)]).strip() for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, [(k, t, "", "") for k, t in enumerate(texts)])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}

    def least(p, t):  # of p to any stretch of t, and that stretch's start, by a table of (distance, start)
        row = [(j, 0) for j in range(len(p) + 1)]
        best = row[-1]
        for at, c in enumerate(t, 1):
            new = [(0, at)]
            for k, x in enumerate(p):
                new.append(min((row[k][0] + (x != c), -row[k][1]), (row[k + 1][0] + 1, -row[k + 1][1]), (new[k][0] + 1, -new[k][1])))
                new[-1] = (new[-1][0], -new[-1][1])
            row = new
            if row[-1][0] < best[0]:
                best = row[-1]
        return best

    found = 0
    for i, text in enumerate(texts):
        norm = decontaminate.folded(text)
        for k, item in items:
            distance, start = least(item, norm)
            assert ((i, k) in got) == (distance <= min(int(0.05 * len(item)), len(item) // 8 - 1))
            if (i, k) in got:
                found += 1
                assert got[i, k]["distance"] == distance and text[got[i, k]["start"] :].startswith(norm[start:].split(" ")[0]) or norm[start] == " "
    assert found > 10
    one = decontaminate.contaminated(table(spark, [(1, "aa bb the quck brown fox jumps over a lazy dog by the rivr bnk yy", "", "")]), spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog by the river bank")], "item_id bigint, text string"), error_rate=0.1).first()
    assert (one["start"], one["distance"]) == (6, 3)
    assert decontaminate.contaminated(docs.unionByName(docs), bench).count() == 2 * len(got)


def test_short_items(spark):
    bench = spark.createDataFrame([(0, "What is 2 + 2?"), (1, "法国的首都是哪里？"), (2, "Name the capital: Oslo"), (3, "?!"), (4, "art")], "item_id bigint, text string")
    docs = table(spark, [(1, "He asked: what is\n2+2? Nobody knew.", "", ""), (2, "what is 2 + 25", "", ""), (3, "请问法国的首都是哪里呢", "", ""), (4, "name the capitol oslo", "", ""), (5, "Name the Capital (Oslo)", "", ""), (6, "start of a party; ART.", "", ""), (7, "a party", "", "")])
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 0), (3, 1), (5, 2), (6, 4)} and all(r["distance"] == 0 for r in got.values())
    assert "start of a party; ART."[got[6, 4]["start"] : got[6, 4]["end"]] == "ART"
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench).collect()) == [2, 4, 7]


def test_decontamination_in_blocks(spark, monkeypatch):
    items = [(k, prose(30)) for k in range(6)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    got = decontaminate.contaminated(table(spark, [(k, t, "", "") for k, t in items]), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, k) for k in range(6)]


# --- 5 chat ---


def render(template, **values):
    return list(chat.compile_template(template)(values))


def test_templates():
    assert "".join(t for t, _ in render("{% for m in ms %}{% if loop.first %}<{% endif %}{{ m.a | upper }}{% if not loop.last %},{% else %}>{% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}])) == "<X,Y>"
    assert render("a{% generation %}{{ x }}{% endgeneration %}b", x="t") == [("a", False), ("t", True), ("b", False)]
    assert chat.fold(chat.parse("{% if 1 < 2 and not false %}{{ 'a' ~ 1 + 1 }}{% else %}{{ x }}{% endif %}!")) in (("block", [("text", "a11!")]), ("block", [("text", "a2!")]))
    assert "".join(t for t, _ in render("{% set y = x | default('d') | length %}{{ y }}{# no #}", x=None)) == "1"
    assert render("{{ '}}' ~ \"%}\" }}{% if x == '%}' %}y{% endif %}", x="%}") == [("}}%}", False), ("y", False)]
    for deep in ("(" * 3000 + "1" + ")" * 3000, "not " * 3000 + "x", "x" + "[x" * 3000 + "]" * 3000, "x" + " + 1" * 3000, "x" + ".y" * 3000):
        with pytest.raises(chat.TemplateError):
            chat.compile_template("{{ " + deep + " }}")
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{% if x %}" * 3000 + "{% endif %}" * 3000)
    assert "".join(t for t, _ in render("{{ " + "(" * 50 + "1" + ")" * 50 + " }}")) == "1"
    for bad in ("{{ 'x }}", "{% if x %}", "{{ x.__class__ }}", "{{ __import__ }}", "{{ f(1) }}", "{{ x | run }}", "{% for %}{% endfor %}", "{% endif %}", "{{ 1 + }}", "{% else %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert "".join(t for t, _ in render("{{ x.real }}{{ y.z }}", x=3, y={"z": None})) == ""


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "<turn user>\n", "\\\\<", "", None, "é\n\n🙂", "a\\", "</turn>\n<turn x>"]
    rows = [(k, n, RNG.choice(["user", "assistant", "system", None, "<r>"]), RNG.choice(nasty)) for k in range(30) for n in range(RNG.randint(1, 6))] + [(99, n, "assistant", prose(3000) + "<\\") for n in range(40)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert len(got) == 32
    for k in got:
        own = [(r or "", t or "") for c, _, r, t in rows if c == k]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[k]["n_turns"] == len(own) and got[k]["loss_chars"] == len(loss)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(turns).where("conv_id = 99").count() > 1
    long = spark.createDataFrame([(1, 0, "assistant", "<\\é\n" * 1_000_000)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.read_back(chat.format_conversations(long)).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (1, 4_000_000, hashlib.sha256(("<\\é\n" * 1_000_000).encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0


# --- 6 mixing ---


def test_mixing(spark):
    docs, labels = labelled(spark)
    named = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("domain"))
    model = mixing.train(docs, named)
    got = mixing.mix(docs, model, {"fine": 0.5, "toxic": 0.5}).cache()
    k = model.domains.index("toxic")
    total = got.agg(F.sum("tokens")).first()[0]
    held = got.agg(F.sum(F.col("rate") * F.col("tokens") * F.col("posterior")[k])).first()[0]
    assert abs(held / total - 0.5) < 0.01 and got.where("rate < 0").count() == 0
    assert set(docs.columns) - {"rate"} <= set(got.columns)
    out = mixing.mix(odd(spark), model, {"fine": 1.0})
    assert out.count() == 10 and out.where("text IS NULL").first()["tokens"] == 0
    assert mixing.mix(empty(spark), model, {"fine": 1.0}).count() == 0
    assert mixing.mix(empty(spark), model, {"fine": 1.0}).columns == out.columns


def shared(spark, p, t):
    return spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(p, t)], "p array<double>, tokens bigint")


def least_squares(p, t, goal, ridge, small=mixing.SMALL, steps=60_000):
    """The optimum by plain projected gradient steps."""
    w = 1 / np.maximum(goal / t.sum(), small)
    size = 1 / (np.linalg.eigvalsh(np.sqrt(w)[:, None] * ((p * t[:, None]).T @ p / t.sum()) * np.sqrt(w))[-1] + ridge)
    r = np.ones(len(t))
    for _ in range(steps):
        r = np.maximum(0, r - size * (p @ (w * ((t * r) @ p - goal) / t.sum()) + ridge * (r - 1)))
    return r


@pytest.mark.parametrize("write_every", [3, 1000])
def test_mixing_is_least_squares(spark, monkeypatch, write_every):
    monkeypatch.setattr(mixing, "WRITE_EVERY", write_every)
    monkeypatch.setattr(mixing, "AT_ONCE", 2)
    p, t = np.array([[1, 0], [0, 1], [0.5, 0.5]]), np.array([100.0, 300.0, 200.0])
    descent, told = mixing.solve(shared(spark, p, t).coalesce(1), {"a": 3.0, "b": 1.0}, ["a", "b"], ridge=1e-2, tolerance=1e-9, settled=1e-7)
    r = least_squares(p, t, np.array([450.0, 150.0]), 1e-2)
    assert told["converged"] and np.allclose([told["tokens"]["a"], told["tokens"]["b"]], (t * r) @ p, rtol=1e-4) and np.allclose(descent.rates(p), r, atol=1e-3)


def test_mixing_rates_converge(spark):
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.3, 0.3, 0.1], 300), rng.integers(10, 10_000, 300).astype(float)
    cells = shared(spark, p, t).coalesce(2)
    goal = np.array([0.9, 0.08, 0.02])
    descent, told = mixing.solve(cells, {"a": 0.9, "b": 0.08, "c": 0.02}, ["a", "b", "c"], ridge=1e-2, tolerance=0, settled=1e-6)
    assert told["converged"] and np.abs(descent.rates(p) - least_squares(p, t, goal * t.sum(), 1e-2)).max() < 1e-3
    quick, told = mixing.solve(cells, {"a": 0.9, "b": 0.08, "c": 0.02}, ["a", "b", "c"])
    r = quick.rates(p)
    assert told["converged"] and r.min() >= 0 and np.abs((t * r) @ p / t.sum() - goal).max() <= 0.002 + 1e-9
    assert not mixing.solve(cells, {"a": 1.0}, ["a", "b", "c"], iterations=5, tolerance=1e-6)[1]["converged"]
    docs, labels = labelled(spark)
    model = mixing.train(docs, labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("domain")))
    with pytest.raises(RuntimeError, match="not within the tolerance"):
        mixing.mix(docs, model, {"fine": 0.1, "toxic": 0.9}, iterations=3)
    with pytest.warns(UserWarning, match="can't be met"):
        mixing.mix(docs, mixing.DomainModel(["a", "b"], np.zeros((mixing.BUCKETS + 1, 2))), {"a": 0.9, "b": 0.1}).count()


def test_mix_by_hand(spark):
    """tokens and posteriors from the model in a loop, shares within the tolerance, rates of repeated rows alike."""
    docs, labels = labelled(spark)
    model = mixing.train(docs, labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("fine").alias("domain")))
    both = docs.unionByName(docs.where("doc_id < 9"))
    got = mixing.mix(both, model, {"fine": 0.6, "toxic": 0.4}).collect()
    told = {r["doc_id"]: model.predict(r["text"]) for r in got}
    assert len(got) == 409 and all(r["tokens"] == told[r["doc_id"]][1] and np.allclose(r["posterior"], told[r["doc_id"]][0]) for r in got)
    assert len({(r["doc_id"], r["rate"]) for r in got}) == 400
    p, t, rate = np.array([r["posterior"] for r in got]), np.array([r["tokens"] for r in got]), np.array([r["rate"] for r in got])
    assert np.abs((t * rate) @ p / t.sum() - [0.6, 0.4]).max() <= 0.002 + 1e-9
    order = np.argsort(p[:, 1])
    assert (np.diff(rate[order]) >= -1e-9).all()  # more of what is short


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_mixing_meets_its_targets(spark):
    got = queries.op6_mixing(spark, "/root/testdata/sf0.1")
    n = len(queries.TARGETS)
    sums = got.agg(F.sum("tokens"), *[F.sum(F.col("rate") * F.col("tokens") * F.col("posterior")[k]) for k in range(n)]).first()
    assert all(abs(v / sums[0] - w) < 0.005 for v, (_, w) in zip(sums[1:], sorted(queries.TARGETS.items())))


# --- 7 tokens ---

VOCABULARY = Path(queries.TOKENIZERS) / "byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")
def test_tokens(spark):
    import tiktoken

    encoder = tokens.Encoder.read(str(VOCABULARY))
    plain = encoder.built()[0]
    assert isinstance(plain, tiktoken.Encoding)
    texts = ["one two\nthree  four\n\nfive", "\n", "é🙂\n\r\nx", "a" * 5000, "x\n" * 300]
    docs = table(spark, [(k, t, "", "") for k, t in enumerate(texts)])
    for rule in tokens.RULES:
        for r in tokens.with_token_counts(docs, encoder, rule).collect():
            assert r["tokens"]["n_tokens"] == len(plain.encode_ordinary(r["text"])) == round(sum(r["tokens"]["section_tokens"]), 6)
            assert len(r["tokens"]["section_tokens"]) == len([x for x in re.split(r"(?<=\n)", r["text"]) if x])
    odd_rows = {r["doc_id"]: r["tokens"] for r in tokens.with_token_counts(odd(spark), encoder).collect()}
    assert odd_rows[1]["n_tokens"] == odd_rows[2]["n_tokens"] == 0 and odd_rows[1]["section_tokens"] == []
    assert tokens.with_token_counts(empty(spark), encoder).count() == 0
    by = tokens.with_field_tokens(docs, encoder, ["text", "kind"]).first()["field_tokens"]
    assert sum(by) == len(plain.encode_ordinary(texts[0] + "\nk"))


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")
@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u3000", " \n", "\x1c"])
def test_long_runs_of_white_space(monkeypatch, run):
    encoder = tokens.Encoder.read(str(VOCABULARY))
    texts = [before + run * n + after for n in (2, 20, 300) for before in ("", "ab", "'s") for after in ("", "cd", "'s", "9", "!", "\ufeff")]
    want = [encoder.spans(t).tolist() for t in texts]
    assert all(len(w) - 1 == len(encoder.built()[0].encode_ordinary(t)) for w, t in zip(want, texts))
    monkeypatch.setattr(tokens, "LONG_RUN", re.compile(tokens.LONG_RUN.pattern.replace("10000", "2")))
    assert [encoder.spans(t).tolist() for t in texts] == want


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")
def test_tokens_of_very_long_runs(spark):
    encoder, n = tokens.Encoder.read(str(VOCABULARY)), 2_000_000
    docs = table(spark, [(1, "a" + " " * n + "b", "", ""), (2, "x" * n, "", ""), (3, "\n" * n, "", ""), (4, " " * n, "", "")])
    got = {r["doc_id"]: r for r in tokens.with_token_counts(docs, encoder).select("doc_id", F.size("tokens.section_start").alias("n"), tokens.total(F.col("tokens.section_tokens")).alias("t"), "tokens.n_tokens").collect()}
    assert {k: r["n"] for k, r in got.items()} == {1: 1, 2: 1, 3: n, 4: 1} and all(round(r["t"]) == r["n_tokens"] > 0 for r in got.values())


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")
def test_sections_by_hand(spark):
    """Section counts against a loop over tokens and lines."""
    encoder, rng = tokens.Encoder.read(str(VOCABULARY)), random.Random(8)
    texts = ["".join(rng.choice(["word ", "\n", "\n\n", "é", "a b", " ", "\r\n", "🙂", "42"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    docs = table(spark, [(k, t, "", "") for k, t in enumerate(texts)])
    for rule in tokens.RULES:
        for r in tokens.with_token_counts(docs, encoder, rule).collect():
            lines, at = [], 0
            for line in re.findall(r"[^\n]*\n|[^\n]+", r["text"]):
                lines.append((at, at + len(line.encode())))
                at = lines[-1][1]
            want, at, crossing = [0.0] * len(lines), 0, 0
            for token in encoder.built()[0].decode_tokens_bytes(encoder.built()[0].encode_ordinary(r["text"])):
                held = [max(0, min(b, at + len(token)) - max(a, at)) for a, b in lines]
                at += len(token)
                crossing += sum(h > 0 for h in held) > 1
                if rule == "split":
                    want = [w + h / len(token) for w, h in zip(want, held)]
                else:
                    want[held.index(max(held)) if rule == "majority" else next(k for k, h in enumerate(held) if h)] += 1
            assert np.allclose(r["tokens"]["section_tokens"], want) and r["tokens"]["n_crossing"] == crossing


def test_allocation_rules():
    ends, starts = np.array([0, 3, 7, 10]), np.array([0, 4, 9])
    assert tokens.attribute(ends, starts, "start")[0].tolist() == [2, 1, 0]
    assert tokens.attribute(ends, starts, "majority")[0].tolist() == [1, 2, 0]
    assert np.allclose(tokens.attribute(ends, starts, "split")[0], [1.25, 0.75 + 2 / 3, 1 / 3])


# --- 8 n-gram join ---


def brute(rows, words=5, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(rng, n=260):
    """Chains of near copies, one large group of them, shared passages, exact copies and short texts."""
    base, passage = prose(120, rng=rng).split(), prose(60, rng=rng)
    rows = []
    for k in range(n):
        kind = k % 5
        words = list(base)
        if kind == 0:
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(ENGLISH)
        elif kind == 1:
            words = (rows[-5][1] if len(rows) > 5 else prose(100, rng=rng)).split()
            words[rng.randrange(len(words))] = rng.choice("xyz") * 3
        elif kind == 2:
            words = (passage + " " + prose(rng.randint(3, 40), rng=rng)).split()
        elif kind == 3:
            words = prose(rng.randint(1, 8), ENGLISH[:3], rng).split()
        rows.append((k * 2 + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("light, block, seed", [(24, 256, 1), (2, 8, 2), (4, 5, 3)])
def test_jaccard_components(spark, monkeypatch, light, block, seed):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SALTED", 16)
    rows = near_copies(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_jaccard_of_long_near_copies(spark):
    """Prefixes of more than 2,147 frequent shingles."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(5000)}" for _ in range(12_000)]
    rows = []
    for k in range(8):
        own = words.copy()
        for at in rng.sample(range(12_000), 10):
            own[at] = f"own{k}"
        rows.append((k, " ".join(own), "", ""))
    docs = table(spark, rows).coalesce(1)
    assert ngram_join._sets(docs.select("doc_id", "text"), ngram_join.frequent_shingles(docs, 5), 5, 80).agg(F.max("heavy")).first()[0] > 2147
    assert {r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == {0}


def test_jaccard_of_odd_rows(spark):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd(spark)).collect()]
    assert len(got) == 10 and (1, 0, 1) in got and (2, 0, 2) in got and (8, 0, 8) in got and got.count((5, 1, 5)) == 2
    assert [x for x in got if x[0] is None][0][2] is None
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    docs = table(spark, [(1, "a b c", "", ""), (2, "A  b\tc", "", ""), (3, "", "", ""), (4, None, "", ""), (5, "a b d", "", "")])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


# --- 9 resampling ---


def test_resampling(spark):
    docs, labels = labelled(spark)
    target = labels.where("toxic = 0")
    got = resampling.resample(docs, target, 0.5).join(labels, "doc_id").collect()
    assert len(got) == 400 and sum(r["selected"] for r in got) == 200
    mean = {y: np.mean([r["log_weight"] for r in got if r["toxic"] == y]) for y in (0, 1)}
    assert mean[0] > mean[1]
    out = resampling.resample(odd(spark), target, 0.3)
    assert out.count() == 10 and out.where("selected").count() == 3 and out.where("doc_id = 1").first()["log_weight"] == 0
    assert resampling.resample(empty(spark), target).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 2000])
def test_rank_cut(spark, k):
    rng = random.Random(4)
    for rows in ([rng.gauss(0, 1) for _ in range(1000)], [float(rng.randrange(5)) for _ in range(1000)], [2.5] * 1000, [rng.randrange(2**62) for _ in range(1000)]):
        got = resampling.rank_cut(spark.createDataFrame([(v,) for v in rows], ["v"]), "v", k)
        if k == 0:
            assert got is None
            continue
        edge, due = got
        above = sum(v > edge for v in rows)
        assert edge == sorted(rows, reverse=True)[min(k, 1000) - 1] and above + due == min(k, 1000) and 0 < due <= rows.count(edge)


@pytest.mark.parametrize("fraction", [0, 0.29, 0.5, 1])
def test_resampling_of_repeated_rows(spark, fraction):
    docs = table(spark, [(k % 3, ("a b", "c", None)[k % 3], "", "") for k in range(100)]).repartition(4)
    out = resampling.resample(docs, docs.select("doc_id").where("doc_id = 1"), fraction)
    assert out.count() == 100 and out.where("selected").count() == int(fraction * 100 + 1e-9) and out.columns == [*docs.columns, "n_grams", "log_weight", "noisy_weight", "selected"]
    least, most = out.where("selected").agg(F.min("noisy_weight")).first()[0], out.where("not selected").agg(F.max("noisy_weight")).first()[0]
    assert least is None or most is None or least >= most


@pytest.mark.parametrize("ids", [0, 100_000])
def test_weights_by_hand(spark, monkeypatch, ids):
    """Log weights against counts made in a plain loop, with ids broadcast or joined."""
    monkeypatch.setattr(resampling, "BROADCAST_IDS", ids)
    docs, labels = labelled(spark)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    aim = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    hasher, raw, target = resampling.Hasher(), np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for i, t in rows.items():
        for g in hasher.grams(t):
            raw[g] += 1
            target[g] += i in aim
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in resampling.resample(docs, labels.where("toxic = 0")).collect():
        assert abs(r["log_weight"] - sum(ratio[g] for g in hasher.grams(rows[r["doc_id"]]))) < 1e-6


def test_same_sample_again(spark):
    docs, labels = labelled(spark)
    a, b = ({r["doc_id"] for r in resampling.resample(x, labels.where("toxic = 0")).where("selected").collect()} for x in (docs, docs.repartition(7)))
    assert a == b


# --- 10 licences ---


def test_licences(spark):
    notices = {"MIT": "Released under the MIT License.", "Apache": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    rows = [(k, prose(30) + "\n" + t + "\n" + prose(30), "", "") for k, t in enumerate(notices.values())]
    rows += [(50, "He lost his fishing licence and asked for permission.", "", ""), (51, prose(200), "", "")]
    got = {r["doc_id"]: r["family"] for r in licences.scan_licences(table(spark, rows)).select("doc_id", licences.family(F.col("licences")).alias("family")).collect()}
    assert got == {**dict(enumerate(notices)), 50: "unknown", 51: "none"}
    out = licences.scan_licences(odd(spark))
    assert out.count() == 10 and out.where("size(licences) > 0").count() == 0 and set(odd(spark).columns) < set(out.columns)
    assert licences.scan_licences(empty(spark)).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_licence_model_and_sql_agree(spark):
    model = licences.LicenceModel()
    texts = [t for f in licences.NOTICES.values() for t in f] + licences.ORDINARY
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", licences.classify(F.col("t"), model).alias("c")).collect()
    for r in rows:
        assert abs(r["c"]["probability"] - model.probabilities(r["t"]).max()) < 1e-3
    right = sum(r["c"]["family"] in {f for f, texts in licences.NOTICES.items() if r["t"] in texts} for r in rows if r["t"] not in licences.ORDINARY)
    assert right >= 0.9 * (len(texts) - len(licences.ORDINARY))
    assert sum(r["c"]["family"] == "unknown" for r in rows if r["t"] in licences.ORDINARY) >= 0.9 * len(licences.ORDINARY)


#: Lines that are in no list of the module, by family.
UNSEEN = {
    "MIT": ["Released under the MIT License.", "Distributed under the MIT/X11 license", "License: MIT", "It is MIT licensed software"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Available under the terms of the Apache License", "License: Apache 2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3", "You can redistribute it under the GPL"],
    "LGPL": ["You may redistribute this under the terms of the LGPL", "GNU Lesser General Public License v3.0"],
    "BSD": ["BSD-licensed", "This file is under a 3-clause BSD license"],
    "MPL": ["Licensed under the Mozilla Public License 2.0", "Source is under MPL 2.0"],
    "EPL": ["Eclipse Public License - v 2.0", "made available under the Eclipse Public License v1.0"],
    "EUPL": ["European Union Public Licence 1.2", "EUPL v1.2"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 3.0 Unported"],
    "CC-BY": ["All photos CC BY 4.0", "CC BY-SA 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC0": ["Public domain (CC0 1.0)"],
    "ISC": ["ISC licensed", "License: ISC"],
    "Boost": ["under the Boost Software License"],
    "Zlib": ["zlib licensed"],
    "Proprietary": ["All rights reserved.", "(c) 2021 Foo Inc. All rights reserved"],
    "unknown": ["the public rights again was lost", "Permission is granted to park here", "The driver's license of the public library was renewed", "licensed under the Microsoft Public License", "The licence of the pub ends in May", "A permission slip for the school trip", "Her copyright lawyer moved to Boston", "The general spoke to the public about the version of events", "All of the software team reserved rooms", "They sell free range eggs under no conditions"],
}


def test_licences_of_unseen_lines():
    model = licences.LicenceModel()
    known = {t for own in (licences.NOTICES, licences.CLAUSES, licences.NAMES) for texts in own.values() for t in texts} | set(licences.ORDINARY)
    right = {False: [], True: []}
    for want, texts in UNSEEN.items():
        for t in texts:
            assert t not in known
            p = model.probabilities(t)
            got = model.families[p.argmax()] if p.max() >= model.least else "unknown"
            right[want == "unknown"].append(got == want)
    assert np.mean(right[False]) >= 0.85 and np.mean(right[True]) >= 0.9


def test_licence_of_a_whole_text(spark):
    body = "\n\n".join("\n".join(textwrap.wrap(t, 70)) for t in licences.CLAUSES["MIT"])
    docs = table(spark, [(1, "Copyright (c) 2001 Someone\n\n" + body, "", ""), (2, "x " * 400_000 + "\n" + licences.CLAUSES["BSD"][0], "", ""), (3, body, "", ""), (3, body, "", "")])
    got = licences.scan_licences(docs).select("doc_id", licences.family(F.col("licences")).alias("family"), "licences").collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == [(1, "MIT"), (2, "BSD"), (3, "MIT"), (3, "MIT")]
    assert got[2]["licences"] == got[3]["licences"]


def test_licence_gate_skips_no_confirmable_line(spark):
    model = licences.LicenceModel()
    lines = {"BSD 3-Clause": "BSD", "Apache 2.0, January 2004": "Apache", "under ISC terms": "none", "tea is available under the bridge": "none"}
    rows = [(k, prose(20) + "\n" + t + "\n" + prose(20), "", "") for k, t in enumerate(lines)]
    got = {r["doc_id"]: r["family"] for r in licences.scan_licences(table(spark, rows), model).select("doc_id", licences.family(F.col("licences")).alias("family")).collect()}
    assert got == dict(enumerate(lines.values()))
    could, rng = regex.compile(licences.pattern(licences.confirmable(model))), random.Random(14)
    for _, template in model.templates:  # words left out at random, in any number
        words, whole = re.findall(licences.WORDS, template.lower()), licences.grams(template)
        for _ in range(300):
            keep = rng.random()
            part = " ".join(w if rng.random() < keep else "x" for w in words)
            if len(licences.grams(part) & whole) >= 0.6 * len(whole):
                assert could.search(part)


WRAPPED = {
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0": "To the extent possible under law, the author has waived all copyright and related rights",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Proprietary": "No part of this publication may be reproduced without prior written permission",
}


def test_wrapped_licences(spark):
    rows, want, rng = [], {}, random.Random(15)
    for family, notice in WRAPPED.items():
        for width, mark in ((75, ""), (60, " * "), (40, "# "), (20, "")):
            body = "\n".join(mark + x for x in textwrap.wrap(notice, width, break_on_hyphens=False, break_long_words=False))
            for parted in ("\n\n", "\n"):
                rows.append((len(rows), prose(25, rng=rng) + parted + body + parted + prose(25, rng=rng), "", ""))
                want[rows[-1][0]] = (family, width, parted, family)
    rows.append((len(rows), "mit den\nund the driving license was\nlost again, all\nthe public rights", "", ""))
    want[rows[-1][0]] = ("unknown", 0, "", "unknown")
    got = {r["doc_id"]: r["family"] for r in licences.scan_licences(table(spark, rows)).select("doc_id", licences.family(F.col("licences")).alias("family")).collect()}
    assert [(w, got[k]) for k, w in want.items() if got[k] != w[0]] == []
