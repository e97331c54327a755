"""Each operator against a brute-force version or an exact round trip, on small tables."""

import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import bpe, embedding_dedup, mixing, pii, preference, quality, registry, simhash, topk_search, toxicity, warc
from foliant.llm.common import components, stars

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def duck(small):
    db = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    made = registry.queries()[name](spark, small)
    result = duck(small).execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(made.columns)
    rows = sorted(repr([dict(zip(columns, r))[c] for c in sorted(columns)]) for r in result.fetchall())
    assert rows == sorted(repr([r[c] for c in sorted(columns)]) for r in made.collect())


# components


@pytest.mark.parametrize("many", [0, 1_000_000])
def test_components(spark, many):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(5), many_links=many).collect()}
    want = roots(2100, pairs)
    assert all(found.get(i, i) == want[i] for i in range(2100))
    assert components(spark.createDataFrame([], "u long, v long"), many_links=many).count() == 0
    u, v = stars(np.array([5, 4, 9]), np.array([4, 1, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {5: 1, 4: 1, 9: 8}


# 1


def test_preference_pairs(spark):
    turn = "struct<role:string,text:string>"
    rows = [
        (1, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "dd")], [("user", "a"), ("assistant", "b"), ("user", "x"), ("assistant", "e")]),
        (2, [("user", "a")], [("user", "a")]), (3, [], [("assistant", "é")]), (4, None, None), (5, [("user", "a")], [("user", "a"), ("assistant", "b")]),
    ]
    out = {r["key"]: r for r in preference.formatted(spark.createDataFrame(rows, f"key long, chosen array<{turn}>, rejected array<{turn}>")).collect()}
    a = out[1]
    assert (a["n_common"], a["prompt"]) == (2, "<|start|>user\na<|end|>\n<|start|>assistant\nb<|end|>\n")
    assert [a["chosen"][s["start"] : s["end"]] for s in a["chosen_mask"]] == ["dd<|end|>\n"]
    assert [a["rejected"][s["start"] : s["end"]] for s in a["rejected_mask"]] == ["e<|end|>\n"]
    assert (out[2]["n_common"], out[2]["chosen"], out[2]["rejected"]) == (1, "", "")
    assert (out[3]["prompt"], out[3]["chosen"], out[3]["rejected_mask"][0]["end"]) == ("", "", 19 + 1 + 8)
    assert (out[4]["n_common"], out[4]["prompt"], out[4]["chosen_mask"]) == (0, "", [])
    assert (out[5]["n_common"], out[5]["chosen"], len(out[5]["rejected_mask"])) == (1, "", 1)


def test_pairs_part_at_any_turn(spark, small):
    """The pairs of the query, its prefix found turn by turn in plain code."""
    turns = collections.defaultdict(set)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns[r["conv_id"]].add((r["turn"], r["role"] or "", r["text"] or ""))
    pairs = preference.pairs_of(preference.conversations_of(spark.read.parquet(f"{small}/conversations.parquet")))
    made, early, never = {r["key"]: r for r in preference.formatted(pairs).collect()}, 0, 0
    show = lambda ts: "".join(f"<|start|>{a}\n{b}<|end|>\n" for a, b in ts)
    for r in pairs.collect():
        a, b = [[tuple(t) for t in side] for side in (r["chosen"], r["rejected"])]
        assert a == [t[1:] for t in sorted(turns[r["key"]])][: len(a)] and a[-1][0] == "assistant"
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        early, never = early + (n < len(a) - 1), never + (n == len(a))
        m = made[r["key"]]
        assert (m["n_common"], m["prompt"], m["chosen"], m["rejected"]) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for side, mask in ((a, m["chosen_mask"]), (b, m["rejected_mask"])):
            assert [show(side[n:])[s["start"] : s["end"]] for s in mask] == [f"{t}<|end|>\n" for role, t in side[n:] if role == "assistant"]
    assert early > len(made) / 10


def test_odd_pairs(spark):
    turn = "struct<role:string,text:string>"
    long = [("user" if i % 2 == 0 else "assistant", "x" * 5000) for i in range(400)]  # 2 MB
    rows = [(None, [(None, None)], [("", "")], 1), (1, [None], None, 2), (1, [None], None, 2), (2, long, long[:-1] + [("assistant", "y")], 3)]
    made = preference.formatted(spark.createDataFrame(rows, f"key long, chosen array<{turn}>, rejected array<{turn}>, prompt int").withColumn("a", F.lit(1))).collect()
    assert sorted((r["key"] or 0, r["n_common"]) for r in made) == [(0, 1), (1, 0), (1, 0), (2, 399)]
    assert preference.formatted(spark.createDataFrame([], f"key long, chosen array<{turn}>, rejected array<{turn}>")).count() == 0


# 2


def plain_pii(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_open_spans_as_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a1. -+@@..11112()0%9é\n4b") for _ in range(rng.randint(0, 60)))
        assert pii.detect(text) == plain_pii(text), text


@pytest.mark.parametrize("text, found", [
    ("mail john dot smith at example dot com now", [("email", "john dot smith at example dot com")]), ("write jane (at) example (dot) org.", [("email", "jane (at) example (dot) org")]),
    ("jane[at]mail.example.com ok", [("email", "jane[at]mail.example.com")]), ("joe＠example．com", [("email", "joe＠example．com")]), ("b​ob@exa​mple.com", [("email", "b​ob@exa​mple.com")]),
    ("аnna@example.com", [("email", "аnna@example.com")]), ("call plus one two three four five six seven eight nine zero", [("phone", "plus one two three four five six seven eight nine zero")]),
    ("call +1 five five five 123 4567 now", [("phone", "+1 five five five 123 4567")]), ("192[.]168[.]1[.]1", [("ip", "192[.]168[.]1[.]1")]), ("+1 (98O) 555-2485", [("phone", "+1 (98O) 555-2485")]),
    ("ip one nine two dot one six eight dot one dot one end", [("ip", "one nine two dot one six eight dot one dot one")]), ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
    ("look at thing.com or at home", []), ("we met at noon. Point taken", []), ("un deux trois", []), ("", []), (None, []),
])
def test_disguises(text, found):
    base, every = pii.find(text)
    shown = [(k, text[a:b]) for k, a, b in every]
    assert [x for x in shown if x in found or not base] == found and all(any(a <= x and y <= b and k == kind for k, a, b in every) for kind, x, y in base)


@pytest.mark.parametrize("text, found", [
    ("call plus 49 170 1234567", [("phone", "plus 49 170 1234567")]), ("Mas 34 600 123456 hoy", [("phone", "Mas 34 600 123456")]), ("john@example . com", [("email", "john@example . com")]),
    ("plus un un un un un un un un un", [("phone", "plus un un un un un un un un un")]), ("a@b.com. Thanks", [("email", "a@b.com")]), ("Ask us. ann@b.com", [("email", "ann@b.com")]),
])
def test_disguises_without_other_hints(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == found


@pytest.mark.parametrize("text, found", [
    ("to a.b.c.d.e (at) example.com", [("email", "a.b.c.d.e (at) example.com")]), ("a dot b dot c dot d dot e dot f at g dot org", [("email", "a dot b dot c dot d dot e dot f at g dot org")]),
    ("jean arobase exemple.fr ici", [("email", "jean arobase exemple.fr")]), ("Juan ARROBA mail.ejemplo.es. luego", [("email", "Juan ARROBA mail.ejemplo.es")]),
    ("la touche arobase marche. elle", []), ("meet ann at example.com", []), ("..ann (at) b.com", [("email", "..ann (at) b.com")]),
    ("+49 170 five 234567", [("phone", "+49 170 five 234567")]), ("plus 49 170 five 234567", [("phone", "plus 49 170 five 234567")]), ("+33 612345678 un 2", [("phone", "+33 612345678")]),
    ("+33 612345678. Un jour", [("phone", "+33 612345678")]), ("room 170 five 234567 of", []),
])
def test_rare_disguises(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == found


@pytest.mark.parametrize("text, found", [
    ("call plus one double two triple five oh nine six now", [("phone", "plus one double two triple five oh nine six")]), ("plus forty nine one seventy double 3 six seven eight", [("phone", "plus forty nine one seventy double 3 six seven eight")]),
    ("+1 five five five twenty-three forty 12 four", [("phone", "+1 five five five twenty-three forty 12 four")]), ("+49 170 1234567 ten people", [("phone", "+49 170 1234567")]),
    ("ip ten dot one dot two dot three", [("ip", "ten dot one dot two dot three")]), ("a double room for twenty, ten of us", []), ("más uno doble dos tres cuatro cinco seis siete ocho", [("phone", "más uno doble dos tres cuatro cinco seis siete ocho")]),
])
def test_numbers_in_words(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == found


def test_a_long_text_in_linear_time():
    begun = time.process_time()
    text = "ten double five twenty one (at) b dot c plus 49 one two " * 20_000  # 1 MB
    base, every = pii.find(text)
    assert base == [] and len(every) >= 20_000 and time.process_time() - begun < 30


def test_long_dotted_names_take_linear_time():
    begun = time.process_time()
    for text in ("a . " * 50_000, "a dot " * 50_000, "a." * 50_000 + "b (at) c.com", "a" * 300_000 + " (.) at"):
        pii.find(text + " (at) arobase @ ")
    assert time.process_time() - begun < 20


def test_unrelated_words_change_nothing():
    rng = random.Random(7)
    parts = ["plus", "más", "49", "170", "1234567", "+1", "five", "un", "fünf", "nine", "at", "chez", "(at)", "@", "[.]", "dot", ".", " . ", "punto", "ann", "b.com", "example", "O5l", "１", "а", "4111", "10", ",", "\n", "PLUS", "ſix"]
    rest = " ; point ; null ; two ; plus ; (dot) ; at ; 5O ; а ;"
    for _ in range(20_000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12))) + " ;"
        assert pii.find(text) == pii.find(text + rest), text


def test_base_spans_stay():
    rng = random.Random(3)
    for _ in range(3000):
        text = " ".join(rng.choice(["a@b.co", "at", "dot", "(at)", "one", "five", "+1 234 567 8901", "10.0.0.1", "x", "4111 1111 1111 1111", "é", "．"]) for _ in range(rng.randint(0, 14)))
        base, every = pii.find(text)
        assert base == pii.detect(text) and set(base) <= set(every)
        assert all(0 <= a < b <= len(text) for _, a, b in every)


# 3, 4


def separable(spark, n=600):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        words = [rng.choice(["plain", "words", "here", "and", "there", "thing", "other"]) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["grobnik", "gr0bnik", "gröbnik", "vlork" + rng.choice("abcdefg") * 2])
        if i % 3 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words) + ".", "en", "s", 1))
        labels.append((i, int(i % 3 != 0), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns(spark):
    docs, labels = separable(spark)
    lexicon = toxicity.learn(docs, labels)
    assert "=grobnik" in lexicon.weights and any(e.startswith("^vlor") for e in lexicon.weights)
    rows = toxicity.scored(docs, lexicon).select("_row.doc_id", "score", "predicted").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    assert toxicity.learn(docs, labels).weights == lexicon.weights
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_rare_insults_beside_many_frequent_words(spark, monkeypatch):
    rng = random.Random(8)
    common = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(5200))
    rows = [(i, common + (" grobnik" if i % 4 == 0 and i % 3 else ""), "en", "s", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    lexicon = toxicity.learn(docs, labels)
    assert set(lexicon.weights) == {"=grobnik", "^grob", "^grobn", "^grobni"}
    monkeypatch.setattr(toxicity, "HELD_COUNTS", 15_000)
    assert toxicity.learn(docs, labels).weights == lexicon.weights


def test_exception_phrases_and_length():
    lexicon = toxicity.Lexicon({"=bad": 3.0, "^ba": 1.0}, ["not bad"])
    automaton = lexicon.automaton()
    assert lexicon.features(automaton, "a not bad day")[0] == 0
    short, long = lexicon.features(automaton, "a B4D day"), lexicon.features(automaton, "a bad day " + "x " * 500)
    assert short[0] == long[0] > 0 and short[1] > long[1]


def plain_words(text):
    """Character by character, without the shortcuts of toxicity.words."""
    text = re.sub(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])|(?<!\w)[@$!](?=[^\W\d_]{2})", lambda m: toxicity.LEET_SIGNS[m[0]], (text or "").lower())
    return "".join(toxicity.TABLE.get(ord(c), c) or "" for c in text)


def plain_weight(lexicon, text):
    """(weight, words) by trying every entry and phrase at every word."""
    found = re.findall(r"[^\W_]+", plain_words(text))

    def best(w):
        return max([v for e, v in lexicon.weights.items() if (e[0] == "=" and e[1:] == w) or (e[0] == "^" and w.startswith(e[1:]))], default=0.0)

    for i, w in enumerate(found):
        forms = [w]
        for k in range(w.count("1")):
            forms = [f.replace("1", x, 1) for f in forms for x in "il"]
        if w.count("1") > toxicity.MOST_ONES:
            forms = [w.replace("1", "i"), w.replace("1", "l")]
        found[i] = max(forms, key=best)
    spared = {j for i in range(len(found) - 1) if f"{found[i]} {found[i + 1]}" in lexicon.exceptions for j in (i, i + 1)}
    return sum(best(w) for i, w in enumerate(found) if i not in spared), len(found)


def test_matches_as_a_plain_matcher():
    lexicon = toxicity.Lexicon({"=bad": 3.0, "^ba": 1.0, "=clown": 2.0, "^vlor": 1.5, "=idiot": 4.0, "^bad": 0.5, "=scum": 2.5}, ["not bad", "bad clown", "vlorx not"])
    automaton, rng = lexicon.automaton(), random.Random(13)
    parts = ["bad", "Not", "not bad", "clown", "c1own", "1d1ot", "VLORX", "vlorx not", "b\u0430d", "b4d", "bä\u0308d", "ｂａｄ", "n\u200bot", "$cum", "b@d", "4", "１１", "i1l1i1", "x_bad", "bad,not", "ß", "١", "①", "ba", "baz", "é!a", "•", "\n", "٫x", "З3"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(0, 14)))
        total, n = plain_weight(lexicon, text)
        log, density = lexicon.features(automaton, text)
        assert abs(log - np.log1p(total)) < 1e-9 and abs(density - (total / (n + 20) if n else 0)) < 1e-9, text


def test_long_texts_are_scored_in_linear_time():
    lexicon = toxicity.Lexicon({"=bad": 3.0, "^ba": 1.0}, ["not bad"])
    automaton, begun = lexicon.automaton(), time.process_time()
    assert lexicon.features(automaton, "bad not bad " * 420_000)[0] == pytest.approx(np.log1p(3.0 * 420_000))  # 5 MB
    assert lexicon.features(automaton, "b4d n0t b\u0430d " * 100_000)[0] > 0
    assert time.process_time() - begun < 30


def test_quality_learns(spark):
    docs, labels = separable(spark)
    ensemble = quality.learn(docs, labels)
    rows = quality.scored(docs, ensemble).select("_row.doc_id", "score", "predicted").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98 and 0 < len(ensemble.rules) < 200


def plain_statistics(text):
    import regex

    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    count = lambda p: len(regex.findall(p, t))
    return [
        len(t), len(words), t.count("\n") + 1, *[count(p) for p in quality.COUNTED.values()], sum(len(w) > 20 for w in words),
        sum(a == b for a, b in zip(words, words[1:])), len(set(words)), len(set(t.split("\n"))),
    ]


def test_statistics_as_plain_counts(spark, small):
    rng = random.Random(14)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [None, "", " \n\t", "a a a\na", "x" * 30 + " " + "x" * 30, "ÀB C1 Éa! 9,9;\n\n", "word Word " * 100_000]
    texts += ["".join(rng.choice(["a", "A", " ", "\n", "9", "é", "É", "!", ".", ",", "@_", "\x0b", "a a "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", quality.words_of(F.col("t")))
    made = rows.select("i", *[c.alias(k) for k, c in quality.statistics(F.col("t"), F.col("w")).items()]).orderBy("i").collect()
    for r, t in zip(made, texts):
        assert list(r)[1:] == plain_statistics(t), t
    whole = quality.with_statistics(rows.select("i", "t"), "t").select("i", "_stat.*").orderBy("i").collect()
    raw = dict(zip(quality.NAMES, plain_statistics(texts[3])))
    assert (whole[3]["twins_per_word"], whole[3]["line_words"]) == (raw["twins"] / raw["words"], raw["words"] / raw["lines"])


def test_scores_as_rules_applied_by_hand(spark, small):
    """Every score against the rules of the learned ensemble, applied one by one."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ensemble = quality.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    made = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.scored(docs, ensemble).select("_row.doc_id", "score", "predicted").collect()}
    for r in quality.with_statistics(docs).collect():
        z = ensemble.bias + sum(w for rule, w in ensemble.rules if all((r["_stat"][n] > c) == above for n, above, c in rule))
        assert abs(made[r["doc_id"]][0] - 1 / (1 + np.exp(-z))) < 1e-9 and made[r["doc_id"]][1] == int(made[r["doc_id"]][0] >= 0.5)


def test_rules_as_columns(spark):
    ensemble = quality.Ensemble(0.5, [((("a", True, 1.0), ("b", False, 2.0)), 1.5), ((("a", False, 1.0),), -0.7)])
    rows = spark.createDataFrame([((0.0, 1.0),), ((2.0, 1.0),), ((2.0, 3.0),)], "_stat struct<a:double,b:double>")
    want = [1 / (1 + np.exp(-(0.5 + z))) for z in (-0.7, 1.5, 0.0)]
    assert np.allclose([r[0] for r in rows.select(ensemble.score()).collect()], want)


# 5


def codec():
    import public_tokenizers

    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def test_stitching():
    """Chunks encoded apart give the ids of the whole text, or say that they share no break."""
    c, rng, apart = codec(), random.Random(5), 0
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "'ll", "'", " 12", "é", "!!", "  x", "😀", "a" * 130, "\t", " " * 150, "word ", "of the ", "1234", "Ω"]
    for n in range(3000):
        text = "".join(rng.choice(parts if n % 3 else parts[:13] + parts[16:]) for _ in range(rng.randint(1, 150)))
        step, overlap = rng.choice([(64, 40), (100, 60), (300, 50)])
        starts = range(0, max(1, len(text) - overlap), step)
        found = [c.counted(text[at : at + step + overlap], k == 0, k + 1 == len(starts), step, overlap) for k, at in enumerate(starts)]
        ids = bpe.stitched(found, step)
        if ids is None:
            apart += 1
            continue
        assert ids == c.encode(text) and c.decode(ids) == text.encode()
    assert 0 < apart < 2000


@pytest.mark.parametrize("sizes", [{}, {"chunk": 64, "overlap": 40}, {"chunk": 4096, "overlap": 256}])
def test_texts_of_any_length(spark, sizes):
    import public_tokenizers

    rows = [(1, "ab c\n\n" * 30000), (2, None), (3, ""), (4, " " * 150000 + "x"), (5, "word's " * 20000), (5, "word's " * 20000), (None, "é"), (6, "x" * 40000), (None, "ab 'll é😀 " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("z")).withColumn("row", F.lit(1)).withColumn("key", F.lit(None).cast("string"))
    out = bpe.encode(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN, with_ids=True, **sizes).collect()
    c = codec()
    want = collections.Counter((k, tuple(c.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)
    assert collections.Counter((r["key"], tuple(r["ids"]), r["decoded_sha256"]) for r in out) == want


# 6


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_xxh64_in_sql():
    """The hashes of the SQL against the library's, for texts of any length."""
    from foliant.llm import simhash_sql

    rng, db = random.Random(1), duckdb.connect()
    words = list({"".join(rng.choice("abcé 😀") for _ in range(n)) for n in range(0, 90) for _ in range(2)} | {"x" * 5000})
    db.register("kinds", pa.table({"shingle": words}))
    found = dict(db.execute(f"WITH RECURSIVE {simhash_sql._hashed()} SELECT shingle, h FROM hashed").fetchall())
    assert found == {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}


def test_masks_cover():
    for level in range(4):
        masks = simhash.masks(level)
        assert len(masks) == 15
        rng = random.Random(level)
        for _ in range(3000):
            flip = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not m & flip for m in masks)


@pytest.mark.parametrize("batch, held", [(1, 1), (7, 20), (40, 100), (400, 100_000)])
def test_buckets_across_batches(monkeypatch, batch, held):
    """Links join what all pairs within each bucket join, however rows fall into batches."""
    monkeypatch.setattr(simhash, "HELD", held)
    rng = np.random.default_rng(batch)
    bucket = np.sort(rng.choice(60, 1500, p=np.r_[0.3, np.full(59, 0.7 / 59)]))
    fp = rng.choice(rng.integers(0, 1 << 62, 40), 1500) ^ (1 << rng.integers(0, 62, 1500)) ^ (1 << rng.integers(0, 62, 1500))
    batches = [pa.RecordBatch.from_arrays([pa.array(bucket[i : i + batch]), pa.array(fp[i : i + batch])], names=["bucket", "fp"]) for i in range(0, 1500, batch)]
    found = [(u, v) for b in simhash._verified(iter(batches), 3) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    place = {f: i for i, f in enumerate(dict.fromkeys(fp.tolist()))}
    near = [(place[fp[i]], place[fp[j]]) for i in range(1500) for j in range(i + 1, 1500) if bucket[i] == bucket[j] and int(fp[i] ^ fp[j]).bit_count() <= 3]
    assert roots(len(place), [(place[u], place[v]) for u, v in found]) == roots(len(place), near) and near


@pytest.mark.parametrize("hot", [4096, 8])
def test_simhash_groups(spark, small, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    base = " ".join(f"w{rng.randrange(50)}" for _ in range(900)).split()
    for i in range(120):  # near copies
        words = list(base)
        words[rng.randrange(900)] = f"z{i}"
        rows.append((10_000 + i, " ".join(words)))
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "One  TWO"), (20_004, "one two"), (None, "one two"), (20_005, "É x")]
    prints = [plain_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = roots(len(rows), near)
    low = collections.defaultdict(list)
    for i, g in enumerate(group):
        low[g].append(rows[i][0] if rows[i][0] is not None else 10**9)
    want = collections.Counter((rows[i][0], prints[i], min(low[g])) for i, g in enumerate(group))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("key", F.lit(1))
    made = simhash.near_duplicates(docs)
    assert collections.Counter((r["key"], r["fp"] % (1 << 64), r["component"]) for r in made.collect()) == want
    kept = [r["doc_id"] for r in simhash.deduplicated(docs).collect()]
    assert sorted(kept) == sorted(min(v) for v in low.values())


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dedup_by_row_where_keys_repeat(spark, parts):
    """Against brute force: one row of each group, the same in any partitioning, and no group is lost."""
    a, b, c = "one two three four five six", "seven eight nine ten eleven", "a quite different text of words"
    rows = [(2, a, "x"), (5, b, "x"), (5, a, "x"), (5, b, "x"), (5, b, "y"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (7, c, "x"), (8, None, "x"), (9, "", "x"), (None, " ", "z"), (4, a.upper(), "x")]
    rng = random.Random(parts)
    rows += [(rng.choice([1, 2, 3, None]), rng.choice([a, b, "lone " + str(rng.randrange(4))]), rng.choice("xy")) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").withColumn("mark", F.lit(None).cast("int")).repartition(parts)
    kept = [(r["doc_id"], r["text"], r["_row"]) for r in simhash.deduplicated(docs).collect()]
    prints = [plain_print(t) for _, t, _ in rows]
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = collections.defaultdict(list)
    for (k, _, _), g in zip(rows, group):
        least[g].append((k is None, k or 0))
    assert len(kept) == len(least) and set(kept) <= set(rows)
    print_of = dict(zip([t for _, t, _ in rows], group))
    assert sorted((print_of[t], k is None, k or 0) for k, t, _ in kept) == sorted((g, *min(v)) for g, v in least.items())
    assert sorted(map(repr, kept)) == sorted(repr((r["doc_id"], r["text"], r["_row"])) for r in simhash.deduplicated(docs.repartition(parts + 1)).collect())


def test_simhash_of_a_long_text(spark):
    text = "word " * 200_000 + "end of it " * 100_000
    made = simhash.near_duplicates(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert {(r["key"], r["fp"] % (1 << 64), r["component"]) for r in made} == {(1, plain_print(text), 1), (2, plain_print(text), 1)}


# 7


def test_archives(spark):
    big, rng = "x" * 1200, random.Random(7)
    rows = [(1, "u", big), (2, "u\r\nWARC-Type: x", big), (3, None, big), (4, "u", None), (5, "u", ""), (None, "u", big), (7, "u", "é" * 400), (8, "u", "é" * 400), (9, "u", "é" * 500), (10, "u", "é" * 500), (3, "u", big)]
    rows += [(100 + i, f"http://h/{i}", "<html>" + " ".join(rng.choice(["alpha", "beta", "gamma\r\n\r\n"]) for _ in range(300)) + "</html>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).withColumn("size", F.lit(0))
    manifest = warc.write(pages.repartition(2))
    made = warc.read_back(spark, manifest).collect()
    most = collections.defaultdict(int)
    for i, _, h in rows:
        most[h or ""] = max(most[h or ""], i or 0)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        to = most[h or ""] if len(data) >= 1000 and i != most[h or ""] else None
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert collections.Counter(tuple(r) for r in made) == want
    first = manifest.first()["path"].removeprefix("file:")
    with open(re.sub("^/+", "/", first), "rb") as f:
        assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")


def test_frames_one_by_one(tmp_path):
    """Archives of many small and some large frames, read in any portions, in linear time."""
    import io

    rng = random.Random(18)
    records = [warc.record(i, "u", bytes(rng.choices(b"abc <>", k=rng.choice([0, 5, 900]))), "s", None) for i in range(3000)]
    records += [warc.record(1, "u", bytes(rng.getrandbits(8) for _ in range(3_000_000)), "s", None), warc.record(2, "u", b"x" * 5_000_000, "s", None), b""]
    out = io.BytesIO()
    writer = warc.Writer(out)
    for r in records:
        writer.add(r)
    writer.close()
    assert list(warc.read(io.BytesIO(out.getvalue()))) == records
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(out.getvalue()[:-3])))
    begun, many = time.process_time(), io.BytesIO()
    writer = warc.Writer(many)
    for i in range(60_000):
        writer.add(records[i % 3000])
    writer.close()
    assert sum(1 for _ in warc.read(io.BytesIO(many.getvalue()))) == 60_000 and time.process_time() - begun < 20


# 8


@pytest.mark.parametrize("sizes", [[50, 40, 30, 20, 10], [1000, 1, 1, 1, 1], [0, 5, 5], []])
def test_targets(spark, sizes):
    names = [None, *[f"s{i:02d}" for i in range(1, len(sizes))]][: len(sizes)]
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    order = sorted(names, key=lambda n: (n is None, n or ""))
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(order)}
    size, left, target, free = dict(zip(names, sizes)), sum(sizes), {}, set(names)
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        full = {n for n in free if share[n] > 3 * size[n]}
        target |= {n: 3 * size[n] for n in full} if full else share
        left -= sum(3 * size[n] for n in full)
        free = free - full if full else set()
    assert got.keys() == target.keys() and all(abs(got[n] - target[n]) < 1e-6 for n in target)


def plain_mix(rows, u, weights=(1, 2, 3)):
    """Copies of rows (source, size), given each row's u: whole copies, then the lowest ranks until the words left are met."""
    words, names = collections.Counter(), sorted({s for s, _ in rows}, key=lambda n: (n is None, n or ""))
    for s, n in rows:
        words[s] += n
    weight, left, target, free = {n: weights[i % 3] for i, n in enumerate(names)}, sum(words.values()), {}, set(names)
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        full = {n for n in free if share[n] > 3 * words[n]}
        target |= {n: 3.0 * words[n] for n in full} if full else share
        left -= sum(3 * words[n] for n in full)
        free = free - full if full else set()
    copies = [0] * len(rows)
    for s in names:
        own = [i for i, r in enumerate(rows) if r[0] == s]
        whole = int(target[s] / words[s] + 1e-12) if words[s] else 0
        left = max(0.0, target[s] - whole * words[s])
        z = {i: max(1.0, float(str(rows[i][1])[:2]) * 10 ** max(0, len(str(rows[i][1])) - 2)) ** 0.5 for i in own}
        lo, hi = 0.0, 2.0  # the level by bisection
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(1.0, mid * z[i]) * rows[i][1] for i in own) < left else (lo, mid)
        p = {i: min(1.0, hi * z[i]) if left > 0 else 0.0 for i in own}
        rank = {i: 0.0 if p[i] > 1 - 1e-12 else u[i] / (1 - u[i]) / (p[i] / (1 - p[i])) for i in own if p[i] > 0}
        groups, taken = collections.defaultdict(list), 0
        for i, q in rank.items():
            groups[round(q / (1 + q), 12)].append(i)
        for i in own:
            copies[i] = whole
        for q in sorted(groups):
            n = sum(rows[i][1] for i in groups[q])
            if left <= 0 or taken + n / 2 > left + 1e-6:
                break
            taken += n
            for i in groups[q]:
                copies[i] += 1
    return copies, target


@pytest.mark.parametrize("seed", [8, 9])
def test_draw_as_plain_pareto_sampling(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 50, 200, 1234])), rng.choice(["a"] * 9 + ["b", "b", "c", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(F.col("doc_id"), F.col("text"), seed).alias("u")).collect()}
    copies, target = plain_mix([(s, len(t.split())) for _, t, s in rows], [u[i] for i, _, _ in rows])
    made = mixing.mix(docs, mixing.word_count(F.col("text")), seed=seed).collect()
    assert {r["_row"]["doc_id"]: r["copies"] for r in made} == {i: c for (i, _, _), c in zip(rows, copies)}
    assert all(abs(r["target"] - target[r["_row"]["source"]]) < 1e-6 for r in made)
    p = collections.defaultdict(list)  # longer documents are likelier
    for (_, t, s), c in zip(rows, copies):
        if s == "a" and t:
            p[len(t.split())].append(c)
    assert np.mean(p[1234]) > np.mean(p[50]) >= np.mean(p[1])


def test_inclusion_expects_the_words_left(spark):
    rows = [("a", 1, 100, 5000.0), ("a", 100, 3000, 5000.0), ("a", 5000, 5000, 5000.0), ("b", 10, 10, 0.0), (None, 3, 9, 9.0)]
    made = mixing.inclusion(spark.createDataFrame(rows, "source string, class long, words long, left double")).collect()
    got = collections.Counter()
    for r in made:
        assert 0 <= r["p"] <= 1
        got[r["source"]] += r["p"] * r["words"]
    assert got["a"] == pytest.approx(5000) and got["b"] == 0 and got[None] == pytest.approx(9)


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 200])), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1) for i in range(1500)]
    rows += [(None, "x y", "en", "b", 1), (None, None, "en", "b", 1), (3, "dup dup", "en", "d", 1), (3, "dup dup", "en", "d", 1), (9999, "w " * 1_000_000, "en", "e", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("size", "copies", "u", "class", "_row", "_m_p"):
        docs = docs.withColumn(c, F.lit("z"))
    runs = []
    for parts in (1, 7):
        out = mixing.mix(docs.repartition(parts), mixing.word_count(F.col("text"))).collect()
        runs.append(collections.Counter((r["_row"]["doc_id"], r["size"], r["taken"], r["copies"]) for r in out))
    assert runs[0] == runs[1] and len(out) == len(rows)
    taken, target, largest = collections.Counter(), {}, collections.Counter()
    for r in out:
        s = r["_row"]["source"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert mixing.copied(docs, mixing.word_count(F.col("text"))).count() == sum(r["copies"] for r in out)


# 9, 10


def vectors(spark):
    rng = np.random.default_rng(9)
    rows = []
    centres = rng.standard_normal((12, 8))
    for i in range(500):
        x = centres[i % 12] + rng.standard_normal(8) * rng.choice([0.05, 0.2, 0.6])
        rows.append((i, [float(v) for v in x.astype(np.float32)], int(i % 3)))
    rows += [(600 + i, rows[0][1], 0) for i in range(20)]
    rows += [(700, None, 0), (701, [0.0] * 8, 0), (702, [None] + [1.0] * 7, 0), (703, [float("nan")] * 8, 0), (704, [float("inf")] * 8, 0), (705, rows[0][1], None), (706, [], 0), (707, rows[0][1][:7], 0), (620, rows[0][1], 0), (620, rows[1][1], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("vec", F.lit(1)).withColumn("id", F.lit(2))


@pytest.mark.parametrize("cell, recall", [(4096, 0.995), (16, 0.995), (4096, 1.0), (16, 1.0)])
def test_embedding_links(spark, monkeypatch, cell, recall):
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", cell)
    if recall == 1:
        monkeypatch.setattr(embedding_dedup, "CELL_AIM", 4)
    rows, df = vectors(spark)

    def able(r):
        return r[1] and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if able(r) else None for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if able(rows[i]) and able(rows[j]) and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    degree = collections.Counter(k for p in near for k in p)
    made = embedding_dedup.near_duplicates(df, recall=recall).collect()
    assert len(made) == len(rows)
    got = sum(r["n_links"] for r in made)
    assert 0.98 * 2 * len(near) <= got <= 2 * len(near)
    have = collections.Counter((r["key"], r["n_links"]) for r in made)
    want = collections.Counter((r[0], degree[i]) for i, r in enumerate(rows))
    assert sum((have & want).values()) >= (0.97 if recall < 1 else 1) * len(rows)
    for r in made:
        assert r["kept"] == (r["key"] == r["component"])
        if 700 <= r["key"] < 707:
            assert (r["n_links"], r["component"]) == (0, r["key"])
    if recall == 1:
        group = roots(len(rows), near)
        low = collections.defaultdict(list)
        for i, g in enumerate(group):
            low[g].append(rows[i][0])
        assert collections.Counter((r["key"], r["component"]) for r in made) == collections.Counter((rows[i][0], min(low[g])) for i, g in enumerate(group))


def test_cells_within_hold_all_that_is_near():
    rng = np.random.default_rng(15)
    x = embedding_dedup.unit(rng.standard_normal((600, 12)))
    y = embedding_dedup.unit(x + 0.1 * rng.standard_normal(x.shape))
    index = embedding_dedup.fit(x, np.zeros(600), 64 * 256, recall=1)
    assert index.visits == 0 and len(index.first) == 16
    cells, radius = index.cells(y), np.sqrt(((x - y) ** 2).sum(1))
    for i in range(600):
        assert cells[i] in index.within(x[i : i + 1], radius[i])[0]
    ranks, order = index.ranks(x, cells), index.nearest(x, 256)
    assert all(order[i, ranks[i] - 1] == cells[i] for i in range(600))


def test_recall_on_links_planted_at_the_threshold(spark):
    """Pairs of a cosine just above the threshold, against all pairs by brute force: nine in ten at least are found."""
    rng = np.random.default_rng(16)
    x = embedding_dedup.unit(rng.standard_normal((3000, 32)))
    step = rng.standard_normal(x.shape)
    step = embedding_dedup.unit(step - (step * x).sum(1, keepdims=True) * x)
    both = np.concatenate([x, 0.9305 * x + np.sqrt(1 - 0.9305**2) * step])
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(both)], "vec_id long, embedding array<double>, label int")
    made = embedding_dedup.near_duplicates(df).collect()
    near = (both @ both.T >= 0.93).sum() - len(both)
    assert 0.95 * near <= sum(r["n_links"] for r in made) <= near and near >= 5000


@pytest.mark.parametrize("limit", [2048, 2 << 20])
def test_topk(spark, monkeypatch, limit):
    monkeypatch.setattr(topk_search, "BYTES", limit)
    monkeypatch.setattr(topk_search, "FIRST", 40)
    rows, df = vectors(spark)
    rows = [(i, v) for i, v, _ in rows] + [(800, [1e30] * 8), (820, [3e7] + [1.0] * 7), (821, [-3e7, 5.5]), (840, [3.4e7] * 8), (841, [1e9])]
    df = df.select("vec_id", "embedding").unionByName(spark.createDataFrame(rows[-5:], "vec_id long, embedding array<float>")).withColumn("block", F.lit("z")).withColumn("row", F.lit(1))
    able = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    able = [(i, v) for i, v in able if sum(x * x for x in v) <= (1 << 62)]  # longer ones take no part
    assert {820, 821} <= {i for i, _ in able} and not {800, 840, 841} & {i for i, _ in able}
    want = collections.Counter()
    for n, (q, a) in enumerate(able):
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for m, (c, b) in enumerate(able) if m != n)
            want.update((q, rank, c, -s) for rank, (s, c) in enumerate(scores[:20], 1))
    made = topk_search.search(df, F.col("vec_id") % 20 == 0).collect()
    assert collections.Counter(tuple(r) for r in made) == want
    few = topk_search.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_topk_in_many_dimensions(spark, spread):
    """Partial sums of several steps, on vectors of equal and of differing length, with many ties."""
    rng = np.random.default_rng(17)
    x = rng.standard_normal((1500, 70)) * (1 / (1 + np.arange(70)))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * (1 + spread * rng.random((1500, 1)))
    x[700:760] = x[7]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    made = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk_search.search(df, F.col("vec_id") % 20 == 0).collect()}
    whole = np.floor(64 * x).astype(np.int64)
    scores = whole[::20] @ whole.T
    for n, row in enumerate(scores):
        q = 20 * n
        order = sorted((-s, c) for c, s in enumerate(row.tolist()) if c != q)[:20]
        assert [made[(q, i)] for i in range(1, 21)] == [(c, -s) for s, c in order]
