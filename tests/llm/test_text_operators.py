"""Operators 2, 5, 7, 8 and 10 against brute force, other libraries and
fixtures of odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolens.llm import ORACLE, QUERIES, bpe, chat, fingerprint, language, pii
from repolens.llm import words as W
from repolens.llm.queries import tokenizer_path
from tests.conftest import SF_SMALL
from tests.oracle import compare

ODD = [None, "", " \t\n ", "a", "The cat sat on the mat.", "<|endoftext|> x<|endoftext|>", "　 é́ 😀\x1c1²", "x" * 5000,
       "mail me@x.org or +1 (555) 123-4567 now", "The cat sat on the mat.", "word " * 30_000]


def _odd(spark):
    return spark.createDataFrame([(i, t, "k", "v") for i, t in enumerate(ODD)], "doc_id long, text string, ids string, spans string")


def test_chat_matches_oracle(spark):
    r = compare(QUERIES["op2_chat_format"](spark, SF_SMALL), ORACLE["op2_chat_format"], SF_SMALL)
    assert r["match"], r


def test_chat_round_trip_and_odd_rows(spark):
    random.seed(3)
    bits = ["\\", "### ", "</turn>", "a", "\n", "#", ":", "%", "%25", "\\\\", "é"]
    for _ in range(3000):
        role, text = ("".join(random.choice(bits) for _ in range(random.randint(0, 7))) for _ in range(2))
        f, a, b = chat.render_turn(role, text)
        assert chat.unescape(f[a:b]) == text and [x[:2] for x in chat.parse(f + f)] == [(role, text)] * 2
    assert chat.render_turn("user", "plain")[0] == "### user:\nplain\n</turn>\n"
    assert chat.parse("### user:\nopen") is None and chat.parse("x") is None
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, 2, "assistant", "</turn>"), (2, 1, "user", "")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    text = "\nfirst\nassistant\nb\nassistant\nb\nuser\n\n"
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["loss_chars"] == 2 and got[None]["loss_sha256"] == hashlib.sha256(b"</turn>").hexdigest() and got[2]["loss_chars"] == 0
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_bpe_small_caches_and_passes(monkeypatch):
    """Turning generations, passes of a few bytes and long pieces change nothing."""
    from tokenizers import Tokenizer

    for name, value in (("CACHE_PIECES", 50), ("CACHE_PAIRS", 40), ("RUN_PIECES", 90), ("PASS_BYTES", 30), ("MATCHES", 7), ("SECTION", 400)):
        monkeypatch.setattr(bpe, name, value)
    with open(tokenizer_path(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    ref = Tokenizer.from_file(tokenizer_path())
    random.seed(8)
    texts = ["".join(random.choice("aeinrst  \n.,é😀12'") for _ in range(random.randint(0, 2000))) for _ in range(60)] + ["the " * 900, "x" * 3000, "<|endoftext|>" * 3]
    for t, ids in zip(texts + texts, v.encode_all(texts) + v.encode_all(texts), strict=True):
        assert ids.tolist() == ref.encode(t, add_special_tokens=False).ids and v.decode(ids) == t
    assert len(v.cache.young) <= 50 and len(v.cache.old) <= 50


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokenizer_path())
    docs = _odd(spark).union(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", F.lit(""), F.lit("")))
    rows = bpe.encode_table(docs, bpe.Tokenizer(spark, tokenizer_path())).select("text", "ids", "decoded").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = ref.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == want and r["decoded"] == ref.decode(want, skip_special_tokens=False)
    one = bpe.encode_table(spark.createDataFrame([("a",)], "text string"), bpe.Tokenizer(spark, tokenizer_path()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("encode(text") == 1  # each text is encoded once
    assert bpe.token_digests(bpe.encode_table(docs.limit(0), bpe.Tokenizer(spark, tokenizer_path()))).count() == 0


def test_bpe_fuzz_and_sections(monkeypatch):
    from tokenizers import Tokenizer

    ref, v = Tokenizer.from_file(tokenizer_path()), bpe.Vocabulary(open(tokenizer_path(), encoding="utf-8").read())
    random.seed(4)
    bits = ["a", "th", "the", " ", "  ", "\n", "ñ", "1", "***", "ing", "'s", "<|endoftext|>", "　", "\x1c", "😀", "abc", "\t", "½"]
    monkeypatch.setattr(bpe, "SECTION", 20)
    for k in range(1500):
        s = "".join(random.choice(bits if k % 2 else "abcdefgh") for _ in range(random.randint(0, 200)))
        assert list(v.encode(s)) == ref.encode(s, add_special_tokens=False).ids
    ids = v.encode("é 😀")
    assert v.decode_bytes(np.array(ids, np.int64)).tobytes().decode() == "é 😀"


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _brute_spans(text):
    def passes(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def test_base_spans_equal_patterns(spark):
    random.seed(5)
    bits = ["a", "b.", "@", ".", "-", "_", "+", "1", "22", "255", "256", "0", " ", "(", "4111111111111111", "é", "x@y.z", "1.2.3.4", "+1 ", "555-"]
    for _ in range(8000):
        s = "".join(random.choice(bits) for _ in range(random.randint(0, 30)))
        assert pii.base_spans(s) == _brute_spans(s), s
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect():
        assert pii.base_spans(r[0]) == _brute_spans(r[0])
    long = ["1" * 300_000, "a" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "@a" * 100_000]
    assert all(isinstance(pii.base_spans(s), list) for s in long)  # linear: ends at once


def _pii_docs(spark):
    rows = [f"note {k} from zaphod and others about item{chr(97 + k)} write z@h2g2.org today" for k in range(6)]
    rows += [f"plain text number {k} about items and others of the day today" for k in range(60)]
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*rows, None, "", "zaphod alone", rows[0]])],
                                 "doc_id long, text string, spans string, term string")


def test_revealing_terms_become_spans(spark):
    docs = _pii_docs(spark)
    terms = pii.revealing_terms(docs)
    found = {(r["value"], r["term"]): r["disclosure"] for r in terms.collect()}
    assert {t for _, t in found} >= {"zaphod", "write"} and not {"others", "today", "itema"} & {t for _, t in found}
    assert all(pii.DISCLOSES <= d <= 1.0 for d in found.values())
    by_broadcast, by_join = (pii.find_spans(docs, terms, max_broadcast=n).orderBy("doc_id").select("doc_id", "text", "spans").collect() for n in (100, 0))
    assert [[(*x,) for x in r["spans"]] for r in by_broadcast] == [[(*x,) for x in r["spans"]] for r in by_join]
    for r in by_broadcast:
        base = [(*x,) for x in r["spans"] if x["kind"] in pii.BASE_KINDS]
        assert base == _brute_spans(r["text"] or "")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).select("doc_id", "text").collect()}
    assert "z@h2g2.org" not in "".join(filter(None, clean.values())) and "[EMAIL]" in clean[0] and "zaphod" not in clean[68]
    assert clean[66] is None and clean[67] == "" and clean[10] == docs.where("doc_id = 10").first()["text"]
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.revealing_terms(docs.limit(0)).count() == 0


def test_sanitise_by_join_equals_broadcast(spark):
    docs = _pii_docs(spark)
    terms = pii.revealing_terms(docs).localCheckpoint()
    by_broadcast, by_join = (sorted(map(repr, pii.sanitise(docs, terms=terms, max_broadcast=n).collect())) for n in (100, 0))
    assert by_broadcast == by_join and len(by_join) == docs.count()
    # Spans that overlap go as one, the first names it; a null text stays null.
    got = pii._cleaned(["ab cd ef", None, "", "abc"], [[("card", 3, 5), ("email", 0, 4)], [], [], [("strong", 1, 2)]])
    assert got.to_pylist() == ["[EMAIL] ef", None, "", "ac"]


def test_copies_alone_make_no_term(spark):
    docs = spark.createDataFrame([(i, "quux frobnicates q@q.org daily") for i in range(50)] + [(99, "other words")], "doc_id long, text string")
    assert pii.revealing_terms(docs).count() == 0


def test_pii_query_on_whole_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op10_pii"](spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        base = _brute_spans(r["text"] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [g[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(b[0] == k for b in base) for k in pii.BASE_KINDS]


def test_fingerprints(spark):
    docs = _odd(spark).select("doc_id", "text").union(spark.createDataFrame([(None, "null id"), (3, "a"), (4, "another four")], "doc_id long, text string"))
    got = sorted((tuple(r) for r in fingerprint.fingerprints(docs).collect()), key=repr)
    assert len(got) == docs.count()
    rows = sorted({((i is not None, i or 0), fingerprint_hash(spark, t), t or "", i) for i, t in docs.collect()})
    want = []
    counts = {}
    for i, t in docs.collect():
        counts[i, t or ""] = counts.get((i, t or ""), 0) + 1
    for k, (_, _, text, i) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        a, b = fingerprint.sketch(text), fingerprint.sketch(edited)
        row = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_string(a), fingerprint.to_string(b),
               fingerprint.compare(a, b)[0], fingerprint.compare(a, fingerprint.sketch(nxt))[0])
        want += [row] * counts[i, text]
    assert got == sorted(want, key=repr)
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    one = fingerprint.fingerprints(docs.where("doc_id = 4 and text like 'The%'")).first()
    assert one["near_next"] == 1.0


def fingerprint_hash(spark, text):
    if not hasattr(fingerprint_hash, "memo"):
        fingerprint_hash.memo = {}
    if text not in fingerprint_hash.memo:
        fingerprint_hash.memo[text] = spark.createDataFrame([(text or "",)], "t string").select(F.xxhash64("t")).first()[0]
    return fingerprint_hash.memo[text]


def test_sketch_merges_and_estimates_containment():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    big = [word() for _ in range(20_000)]
    small = big[5000:6000]
    a, b = fingerprint.sketch(" ".join(big)), fingerprint.sketch(" ".join(small))
    inside, alike = fingerprint.compare(a, b)
    assert inside > 0.95 and alike < 0.1
    other = [word() for _ in range(3000)]
    full = np.union1d(W.shingles(W.split(" ".join(big)), 5), W.shingles(W.split(" ".join(other)), 5))
    assert np.array_equal(fingerprint.merge(a, fingerprint.sketch(" ".join(other))), fingerprint._retained(full))
    assert fingerprint.compare(fingerprint.sketch(""), fingerprint.sketch(None)) == (1.0, 1.0)
    assert np.array_equal(fingerprint.from_string(fingerprint.to_string(a)), a)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    out = language.identify(rest, model, F.lit(None).cast("string"), F.col("source")).cache()
    right, kept, n = out.agg(F.avg((F.col("text_language") == F.col("lang")).cast("int")), F.sum(F.col("keep").cast("int")), F.count("*")).first()
    assert right > 0.97 and kept >= 0.99 * n


def test_language_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None, "en", "h.example.com"), (2, "", None, None), (3, "12 34 !!", "de-AT", "h"), (4, "жёлтый снег идёт " * 30, "ru", "h"),
                                 (5, docs.first()["text"], "xx-unknown", None)], "doc_id long, text string, lang string, source string")
    odd = odd.withColumn("language", F.lit("clash")).withColumn("keep", F.lit("clash"))
    suffix = language.address_suffix(F.col("source"))
    rows = {r["doc_id"]: r for r in language.identify(odd.union(odd), model, F.col("lang"), F.col("source"), suffix).collect()}
    assert len(rows) == 5 and [rows[k]["keep"] for k in (1, 2, 3, 4)] == [False] * 4 and rows[5]["keep"]
    assert abs(rows[5]["confidence"] - 1) < 1 and rows[1]["text_language"] is None
    assert language.identify(odd.limit(0), model, F.col("lang"), F.col("source")).count() == 0
    assert language.fit(docs.limit(0)) is None and language.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    many = language.fit(spark.range(600).select(F.col("id").cast("string").alias("lang"), F.lit("a b").alias("text")))
    assert len(many.languages) == language.MAX_LANGUAGES
    assert language.identify(docs, many, F.col("lang"), F.col("source")).count() == docs.count()


def test_language_query_finds_the_labels(spark):
    rows = QUERIES["op5_language_id"](spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200 and sum(r["language"] == r["lang"] for r in rows) >= 198 and sum(r["keep"] for r in rows) >= 199
    pages = QUERIES["language_id_pages"](spark, SF_SMALL).collect()
    assert pages and all(r["language"] in ("de", "en", "es", "fr") for r in pages)


def test_sanitise_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org", "mine", 1, 2), (2, None, None, 3, 4)], "doc_id long, text string, spans string, row int, `a.b` int")
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "write to [EMAIL]", "mine", 1, 2), (2, None, None, 3, 4)]


def test_more_labels_than_languages(spark):
    """The labels with most texts are the languages; every row is judged."""
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts = [" ".join(random.Random(k * 1000 + j).choice(words[k * 3:k * 3 + 30]) for j in range(40)) for k in range(40)]
    rows = [(i, texts[i % 40], f"x{chr(97 + i % 40 // 26)}{chr(97 + i % 40 % 26)}" if i % 40 < 30 else f"rare{i}", "h.org") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(docs, max_languages=20)
    counts = sorted(((-n, lang) for lang, n in ((r[0], r[1]) for r in docs.groupBy("lang").count().collect())))
    assert model.languages == sorted(lang for _, lang in counts[:20])
    out = language.identify(docs, model, F.col("lang"), F.col("source")).collect()
    assert len(out) == 800 and {r["language"] for r in out} <= set(model.languages)
    right = [r["language"] == r["lang"] for r in out if r["lang"] in model.languages]
    assert sum(right) >= 0.95 * len(right)
