"""The operators of the llm subpackage against brute-force versions, and on odd tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import binomial, bpe, chat, dartminhash, decontaminate, hashed_text, neardup, ordinal, pii, quality_rules, token_file, toxicity, url_reputation
from quantloom.session import written

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, made string, label string, `odd.name` string"


def docs_of(spark, texts, ids=None):
    """Documents with further columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, "src0", len(t or ""), -1, None, 0.5, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "É 日本 🎉 <|endoftext|> it's 12345 ½",
    "same words again and again and more of it here today",
    "same words again and again and more of it here today",
    "x" * 30_000,
    " ".join(f"w{i % 977}" for i in range(20_000)),
]
ODD_IDS = [0, 1, 2, 3, 4, 5, 6, None, 8]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [*ODD_TEXTS, "same words again and again and more of it here today"], [*ODD_IDS, 5])


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


# BPE


def bpe_texts():
    r = random.Random(5)
    mixed = ["".join(r.choice("abcdefgh ERTin'0123,.éß€漢\n\t\u00a0\x1c\x85²") for _ in range(150)) for _ in range(200)]
    return [t for t in ODD_TEXTS if t is not None] + mixed + ["aaaaaaaaaaaaaaaa" * 30, "\u2003 a\u3000b  c   ", "ﬁ Ǆ İ ẞ"]


def test_bpe_equals_library():
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    codec = bpe.codec(bpe.default_vocabulary())
    for text in bpe_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_small_cache_is_exact():
    codec = bpe.BpeCodec(bpe.default_vocabulary(), cache_entries=3)
    whole = bpe.codec(bpe.default_vocabulary())
    assert all(codec.encode(t) == whole.encode(t) for t in bpe_texts()[:20])


def test_bpe_query_on_odd_rows(odd, empty):
    rows = bpe.encode_digests(odd).collect()
    assert len(rows) == odd.count() and bpe.encode_digests(empty).count() == 0
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert {r.ids_sha256 for r in rows if r.doc_id == 0} == {hashlib.sha256(b"").hexdigest()}
    decoded = {r.doc_id: r.decoded for r in bpe.encode_documents(odd).collect()}
    assert decoded[8] == ODD_TEXTS[8] and decoded[None] == ODD_TEXTS[7] and decoded[0] == ""


# Token files


def test_token_file_round_trip(spark, odd, empty):
    library = tokenizers.Tokenizer.from_file(token_file.default_vocabulary())
    manifest = token_file.write_token_files(odd, frame_bytes=4096)
    rows = token_file.read_documents(manifest).collect()
    expected, at = [], 0
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in odd.collect()))
    for *_, text, doc_id in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    assert token_file.read_documents(token_file.write_token_files(empty)).count() == 0


def test_token_file_pieces_equal_library():
    library = tokenizers.Tokenizer.from_file(token_file.default_vocabulary())
    small = token_file.PieceEncoder(token_file.default_vocabulary(), cache_entries=40)
    for text in bpe_texts() + ["don't WE'LL it''s `a`b_c^d 5e3 ½ µm ÀÉ ×÷"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(small.encode([text])[0], small.item).tolist() == ids, text[:60]


def test_token_file_reads_only_wanted_frames_and_checks_them(spark, tmp_path):
    docs = docs_of(spark, [f"word {i} " * 40 for i in range(200)])
    (file,) = token_file.write_token_files(docs.coalesce(1), folder=str(tmp_path), frame_bytes=2000).where("file_no = 0").collect() or [None]
    with token_file.open_file(file.path) as source:
        reader = token_file.FrameReader(source)
        first = next(iter(reader.documents()))[0]
        assert len(reader.table) > 3
        frames = []
        get = reader.frame
        reader.frame = lambda k: frames.append(k) or get(k)
        assert [d for d, _ in reader.documents({first})] == [first] and frames == [0]
    local = file.path.removeprefix("file://")
    raw = bytearray(open(local, "rb").read())
    at = raw.find(b"\x28\xb5\x2f\xfd", 10) + 20
    raw[at] ^= 0xFF
    open(local, "wb").write(raw)
    with token_file.open_file(file.path) as source:
        with pytest.raises(Exception):
            list(token_file.FrameReader(source).documents())


# Decontamination


def brute_hits(text, items, window=10):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, which = word(text), set(), set()
    for item, t in items:
        v = word(t)
        n = min(window, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                which.add(str(item))
    return len(w), len(hit), sorted(which)


@pytest.mark.parametrize("shard_chars", [10**6, 60])
def test_decontaminate_equals_brute_force(spark, odd, shard_chars):
    r = random.Random(3)
    vocab = ["Ab", "cd", "é1", "ef", "x-y"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([12, 3, 25, 0, 10, 1, 14])] + [(7, None), (8, "cd ef Ab cd ef")]
    items[5] = (5, "rare")
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice([5, 40, 300]))) for _ in range(60)] + ["a rare, thing"] + ODD_TEXTS
    found = decontaminate.find_passages(docs_of(spark, texts), benchmark, shard_chars=shard_chars)
    got = {x.doc_id: (x.n_words, x.n_hit, list(x["items"])) for x in found.collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    spans = {x.doc_id: x.spans for x in found.collect()}
    rare = texts.index("a rare, thing")
    assert [texts[rare][s.start : s.stop] for s in spans[rare]] == ["rare"]
    assert all(x.n_hit == sum(g["last"] - g["first"] + 1 for g in x.ranges) for x in found.collect())
    repeated = decontaminate.find_passages(docs_of(spark, texts[:5] * 3, [1, 2, None, 4, 5] * 3), benchmark, shard_chars=shard_chars)
    assert Counter((x.n_words, x.n_hit, *x["items"]) for x in repeated.collect()) == Counter((n, h, *i) for n, h, i in (brute_hits(t, items) for t in texts[:5] * 3))
    kept = decontaminate.drop_contaminated(docs_of(spark, texts), benchmark, shard_chars=shard_chars)
    assert {x.doc_id for x in kept.collect()} == {i for i, g in got.items() if not g[1]} and kept.columns == odd.columns


def test_decontaminate_odd_rows(spark, odd, empty):
    nothing = spark.createDataFrame([], "item_id int, text string")
    assert {r.n_hit for r in decontaminate.find_passages(odd, nothing).collect()} == {0}
    assert decontaminate.find_passages(empty, nothing).count() == 0
    assert decontaminate.drop_contaminated(odd, nothing).count() == odd.count()


# Chat


def test_escape_round_trip():
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("<|\\x") for _ in range(r.randrange(12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_chat_reads_back(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|> <|endoftext|>"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "é🎉"), (3, None, "user", "a"), (3, 2, "assistant", "b\\<\\|c"), (3, 2, "assistant", "b\\<\\|c")]
    table = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, part long, conv_key string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.with_probe(table))).collect()}
    turns = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", chat.PROBE_TEXT), (-1, 1, "assistant", chat.PROBE_TEXT)]:
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(turns)
    for conv, ts in turns.items():
        ts.sort()
        loss = "".join(t for *_, role, t in ts if role == "assistant")
        assert got[conv].n_turns == len(ts)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in ts).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.escape(role)) + len(chat.escape(t)) + sum(map(len, chat.CONTROLS)) + 1 for *_, role, t in ts)
    shuffled = written(chat.format_conversations(chat.with_probe(table)).orderBy(F.rand(3)), "shuffled")
    assert {r.conv_id: r for r in chat.read_back(shuffled).collect()} == got
    long = [(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * (20_000 if k == 5 else 3)) for k in range(400)]
    (one,) = chat.read_back(written(chat.format_conversations(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")), "long")).collect()
    assert one.n_turns == 400 and one.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in long).encode()).hexdigest()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0


# Quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeat = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat)


def rule_texts():
    r = random.Random(9)
    return [" ".join(r.choice("a b c# d é\n".split(" ")) for _ in range(r.choice([3, 8, 30, 200]))) for _ in range(80)] + ["a b c d e", "a b c d e a b c d e", "a a a a a a", "l1\nl1\n \n \nl1"]


def test_quality_counts_equal_brute_force(spark, odd, empty):
    texts = rule_texts() + ODD_TEXTS
    got = {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.features(docs_of(spark, texts)).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}
    assert quality_rules.features(empty).count() == 0 and quality_rules.features(odd).count() == odd.count()


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 700) for k in range(0, min(n, 30)) for p in (0.01, 0.2)]
    for p in (0.01, 0.2):
        df = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in df.withColumn("t", binomial.lower_tail(F.col("k"), F.col("n"), p)).collect():
            q = Fraction(p)
            exact = float(sum(comb(r.n, i) * q**i * (1 - q) ** (r.n - i) for i in range(r.k + 1)))
            assert r.t == pytest.approx(exact if r.k < r.n * p else 1.0, rel=1e-11)


def exact_step(steps, alpha, delta, strata):
    """The strictest proven step for the rejecting steps of a stratum's good documents, by fractions."""
    n, q, taken = len(steps), Fraction(str(alpha)), 0
    for k in range(1, quality_rules.STEPS + 1):
        r = sum(s <= k for s in steps)
        tail = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(r + 1)) if r < n * q else 1
        if tail > Fraction(str(delta)) / strata:
            break
        taken = k
    return taken


def test_quality_steps_equal_brute_force_over_strata(spark):
    r = random.Random(31)
    texts, langs = [], []
    for lang, n, share in (("en", 400, 0.01), ("de", 260, 0.0), ("fr", 300, 0.06), ("es", 40, 0.0)):
        for _ in range(n):
            words = [f"w{r.randrange(9999)}" for _ in range(40)]
            if r.random() < share * 2:
                for k in range(r.choice([1, 2, 4, 8])):
                    words[k] = "$" * r.choice([2, 4, 9])
            if r.random() < share:
                words[20] = "W" * r.choice([9, 60, 200])
            texts.append(" ".join(words)), langs.append(lang)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    feats = written(quality_rules.features(docs), "f")
    per = {}
    for i, (t, lang) in enumerate(zip(texts, langs)):
        n, chars, symbols, dup, repeat = brute_counts(t)
        scores = {"symbols": symbols / chars, "dup_lines": dup / len([x for x in t.split("\n") if x.strip()]), "repeats": repeat / n, "upper": sum(c.isupper() for c in t) / chars, "bangs": t.count("!") / chars}
        if i % 5 and 100 * repeat <= 20 * n:
            per.setdefault(lang, []).append(min(next((k + 1 for k, c in enumerate(cuts) if scores[rule] > c), 99) for rule, cuts in quality_rules.LADDERS.items()))
    for alpha, delta in ((0.02, 0.1), (0.05, 0.1), (0.3, 0.01)):
        got = {x.stratum: (x.n_good, x.n_rejected, x.step) for x in quality_rules.fit(feats, labels, alpha, delta).collect()}
        want = {k: exact_step(v, alpha, delta, 4) for k, v in per.items()}
        assert got == {k: (len(v), sum(s <= want[k] for s in v), want[k]) for k, v in per.items()}
        assert alpha > 0.02 or (want["de"] == quality_rules.STEPS and want["es"] == 0)


def test_quality_steps_keep_their_promise():
    """Over random holdouts the true loss of the chosen step exceeds alpha no more often than promised."""
    r = np.random.default_rng(7)
    loss = np.cumsum([0.002, 0.003, 0.005, 0.008, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07])  # of good documents, by step
    broken = 0
    for _ in range(300):
        u = r.random(300)
        steps = [int(np.searchsorted(loss, x)) + 1 for x in u]
        taken = exact_step(steps, 0.05, 0.1, 1)
        broken += taken > 0 and loss[taken - 1] > 0.05
    assert broken / 300 < 0.1 + 0.03


def test_quality_steps_hold_risk_and_keep_clean_rows(spark, odd, no_labels):
    r = random.Random(2)
    clean = [" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(700)]
    junk = [" ".join(f"w{r.randrange(9999)}$$$" for _ in range(60)) for _ in range(100)]
    docs = docs_of(spark, clean + junk).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(i < 700), None) for i in range(800)] + [(None, 1, 0), (3, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    feats = written(quality_rules.features(docs), "f")
    steps = quality_rules.fit(feats, labels)
    (row,) = steps.collect()
    assert (row.n_good, row.n_rejected, row.step) == (700, 0, quality_rules.STEPS)
    kept = {x.doc_id for x in quality_rules.judge(feats, steps).where("kept").collect()}
    assert kept == set(range(700))
    assert quality_rules.fit(feats, labels.where("doc_id < 20")).first().step == 0  # too few labels to prove anything
    assert {x.doc_id for x in quality_rules.keep_good(docs, labels).collect()} == kept
    stage = quality_rules.keep_good(odd, no_labels)
    assert stage.columns == odd.columns and {x.doc_id for x in stage.collect()} == {5, 6}


def test_quality_steps_count_copies_once(spark):
    """A holdout of 60 different texts proves nothing, however often each is labelled."""
    r = random.Random(8)
    few = [" ".join(f"w{r.randrange(9999)}" for _ in range(40)) for _ in range(60)]
    many = [" ".join(f"w{r.randrange(9999)}" for _ in range(40)) for _ in range(250)]
    docs = docs_of(spark, few * 8 + many * 2)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 480, "few").otherwise("many"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {x.stratum: (x.n_good, x.step) for x in quality_rules.fit(written(quality_rules.features(docs), "f"), labels).collect()}
    assert got == {"few": (60, 0), "many": (250, quality_rules.STEPS)}


# Personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def cards(n):
    r, out = random.Random(4), []
    while len(out) < n:
        d = "".join(r.choice("0123456789") for _ in range(16))
        if luhn(d):
            out.append(d)
    return out


def replaced(spark, texts):
    return [r.text for r in pii.redact(docs_of(spark, texts), "a key").orderBy("doc_id").collect()]


def test_pii_values_are_permuted_within_their_formats(spark):
    values = [*cards(40), "4111 1111 1111 1111", "+1 (743) 555-3824", "212-555-0100", "233.233.171.252", "10.0.0.1", "2024-02-29", "31.12.1999", "12/31/1999", "31/12/1999", "hein.19@mail5.example.com", "078-05-1120"]
    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    new = replaced(spark, [f"a {v}, b" for v in values] + [f'token = "{secret}"'])
    again = replaced(spark, [f"{v} (twice: {v})" for v in values])
    for v, t, twice in zip(values, new, again):
        got = t[2:-3]
        assert t.startswith("a ") and t.endswith(", b") and got != v and len(got) == len(v)
        assert re.sub(r"[a-z]", "a", re.sub(r"\d", "0", got)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "0", v))
        assert twice == f"{got} (twice: {got})"
    assert all(luhn(t[2:-3].replace(" ", "")) for t in new[:41])
    assert len(set(new)) == len(new)
    assert secret not in new[-1] and re.fullmatch(r'token = "[0-9a-f]{40}"', new[-1])


def test_pii_leaves_other_numbers_and_odd_rows(spark, odd, empty):
    same = ["9870157079875996", "2024-02-30", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "12345678901234567890123", "v1.2.3", "1111111111111111", "call 555-3824", "x4111111111111111"]
    assert replaced(spark, same) == same
    out = pii.redact(odd, "a key")
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pii.redact(empty, "a key").count() == 0


def feistel(key, kind, left, right, radix_left, radix_right):
    """The permutation of pairs of numbers, by hand."""
    for i in range(pii.ROUNDS):
        f = lambda half: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:14], 16)
        left, right = ((left + f(right)) % radix_left, right) if i % 2 == 0 else (left, (right + f(left)) % radix_right)
    return left, right


def feistel_string(key, kind, value, move, tweak=""):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(pii.ROUNDS):
        block = lambda half, b: hashlib.sha256(f"{key}|{kind}|{i}|{len(value)}:{tweak}{half}{f'|{b}' if b else ''}".encode()).hexdigest()
        stream = lambda half: "".join(block(half, b) for b in range(len(value) // 32 + 1))
        shift = lambda text, s: "".join(move(c, int(s[j * 4 : j * 4 + 4], 16)) for j, c in enumerate(text))
        left, right = (shift(left, stream(right)), right) if i % 2 == 0 else (left, shift(right, stream(left)))
    return left + right


def by_class(c, by):
    for first, n in (("0", 10), ("a", 26), ("A", 26)):
        if first <= c < chr(ord(first) + n):
            return chr((ord(c) - ord(first) + by) % n + ord(first))
    return c


def brute_pseudonym(key, value):
    from datetime import date, timedelta

    if "@" in value:
        local, domain = value.split("@")
        return feistel_string(key, "email", local, by_class) + "@" + domain
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        at = (date.fromisoformat(value) - date(1800, 1, 1)).days
        a, b = feistel(key, "date", at // 773, at % 773, 189, 773)
        return str(date(1800, 1, 1) + timedelta(a * 773 + b))
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", value):
        area, group, serial = map(int, value.split("-"))
        a, b = feistel(key, "ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + (2 if a >= 665 else 1):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if re.fullmatch(r"(\d+\.){3}\d+", value):
        low, count = lambda x: (0, 10, 100)[len(x) - 1], lambda x: (10, 90, 156)[len(x) - 1]
        p = value.split(".")
        n = [int(x) - low(x) for x in p]
        a, b = feistel(key, "ipv4", n[0] * count(p[1]) + n[1], n[2] * count(p[3]) + n[3], count(p[0]) * count(p[1]), count(p[2]) * count(p[3]))
        return ".".join(str(v + low(x)) for v, x in zip((*divmod(a, count(p[1])), *divmod(b, count(p[3]))), p))
    if re.fullmatch(r"\d{3}-\d{3}-\d{4}", value):
        a, b = feistel(key, "phone", int(value[:3]) - 200, (int(value[4:7]) - 200) * 10_000 + int(value[8:]), 800, 8_000_000)
        return f"{a + 200}-{(b + 2_000_000) // 10_000}-{(b + 2_000_000) % 10_000:04d}"
    if re.fullmatch(r"\d{13,19}", value):
        body = feistel_string(key, "card", value[:-1], by_class)
        return next(body + c for c in "0123456789" if luhn(body + c))
    by_digit = lambda c, by: f"{(int(c, 16) + by) % 16:x}"
    if len(value) <= 128:
        return feistel_string(key, "secret", value, by_digit)
    pieces = [value[i : i + 64] for i in range(0, len(value), 64)]
    return "".join(feistel_string(key, "secret", p, by_digit, f"{j}.{pieces[j - 1] if j else ''}:") for j, p in enumerate(pieces))


def test_pii_permutations_equal_brute_force(spark):
    values = [*cards(8), "2024-02-29", "1999-12-31", "078-05-1120", "899-99-9999", "233.7.171.25", "10.0.0.1", "212-555-0100", "999-999-9999", "Hein.19@mail5.example.com", "a.very.long.local.part.of.more.than.thirty.two.characters@x.org", "deadbeef" * 5, "0123456789abcdef" * 8, "0a1b2c3d" * 23]
    made = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.pseudonym("some key", F.col("v")).alias("p"))
    assert {r.v: r.p for r in made.collect()} == {v: brute_pseudonym("some key", v) for v in values}


def test_pii_finds_values_beside_others(spark):
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    texts = [f"card {card} 12/27", f"{card} 123", f"order 12 {card}", f"1234 {card}", f"{card} {other} 99", "at 2024-01-05T10:00:00Z", f'key = "{"deadbeef" * 4}"', f'key = "{"DEADBEEF" * 4}"', f'key = "0123{"deadbeef" * 4}"']
    alone = replaced(spark, [card, other, "2024-01-05"])
    new = replaced(spark, texts)
    assert new[:6] == [texts[0].replace(card, alone[0]), texts[1].replace(card, alone[0]), texts[2].replace(card, alone[0]), texts[3].replace(card, alone[0]), texts[4].replace(card, alone[0]).replace(other, alone[1]), texts[5].replace("2024-01-05", alone[2])]
    assert alone[0] != card and luhn(alone[0].replace(" ", "")) and luhn(alone[1].replace("-", ""))
    assert all(a != b and len(a) == len(b) for a, b in zip(new[6:], texts[6:])) and re.fullmatch(r'key = "[0-9A-F]{32}"', new[7])
    made = pii.pseudonymise(docs_of(spark, texts), "a key")
    assert {r.doc.doc_id: (r.n_found, r.n_replaced) for r in made.collect()} == {**{i: (1, 1) for i in range(len(texts))}}
    assert "a key" not in made._jdf.queryExecution().toString()
    clash = spark.createDataFrame([(1, card, 2, 3, 4, 5)], "doc_id long, text string, _pii int, _row int, found int, key int")
    assert pii.redact(clash, "a key").first()[2:] == (2, 3, 4, 5) and pii.redact(clash, "a key").columns == clash.columns


def brute_found(text):
    """Cards and secrets of a text, by trying every run of groups and every quoted string."""
    found = []
    for row in re.finditer(r"(?<![\w-])\d+(?!\w)(?:[ -]\d+(?!\w))*", text):
        groups = re.split(r"[ -]", row.group())
        i = 0
        while i < len(groups):
            runs = [n for n in range(min(19, len(groups) - i), 0, -1) if 13 <= len("".join(groups[i : i + n])) <= 19 and luhn("".join(groups[i : i + n])) and len(set("".join(groups[i : i + n]))) > 1]
            if runs:
                found.append("".join(groups[i : i + runs[0]]))
            i += runs[0] if runs else 1
    return found


def test_pii_finds_all_cards_of_long_rows(spark):
    r = random.Random(31)
    good = cards(12)
    texts = ["1234 " * 12 + "4111 1111 1111 1111 x", "7 " * 500 + good[0] + " 9" * 500]
    for _ in range(40):
        parts = [r.choice([str(r.randrange(10 ** r.randrange(1, 8))), r.choice(good), "-".join(re.findall(".{1,4}", r.choice(good))), " ".join(re.findall(".{1,5}", r.choice(good)))]) for _ in range(r.randrange(1, 60))]
        texts.append("row " + "".join(p + r.choice(" -") for p in parts) + r.choice(["", "x", "end"]))
    made = {x.doc.doc_id: (x.text, x.n_replaced) for x in pii.pseudonymise(docs_of(spark, texts), "a key").collect()}
    for i, text in enumerate(texts):
        new, n = made[i]
        was, now = brute_found(text), brute_found(new)
        assert len(new) == len(text) and re.sub(r"\d", "", new) == re.sub(r"\d", "", text)
        assert bool(was) == (new != text) and bool(was) == bool(n)
        assert all(c not in re.sub(r"[ -]", "", new) or c in [brute_pseudonym("a key", w) for w in was] for c in was)
        assert all(brute_pseudonym("a key", w) in re.sub(r"[ -]", "", new) for w in was), (text, was)


def test_pii_hostile_texts(spark):
    """Millions of characters that make a recursive matcher overflow its stack; values beside them are found."""
    n, card = 2_000_000, "4111 1111 1111 1111"
    bodies = ["a." * (n // 2), "7" * n, "deadbeef" * (n // 8), " " * n, "x@" + "a." * (n // 2), "x@" + "a-" * (n // 2), "1." * (n // 2), "12 34 " * 1_000, "'" * n, "1-" * 1_000, "2024-01-" * 2_000]
    texts = [f"card {card}, {b} x" for b in bodies] + [f'key = "{"deadbeef" * 2_500}"', f'key = "{"d" * 129}"']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    got = {x.doc_id: (x.size, x.card, x.end) for x in pii.redact(df, "a key").select("doc_id", F.length("text").alias("size"), F.substring("text", 6, 19).alias("card"), F.right("text", F.lit(40)).alias("end")).collect()}
    assert all(got[i][0] == len(t) for i, t in enumerate(texts))
    assert len({got[i][1] for i in range(len(bodies))}) == 1 and got[0][1] != card
    assert all(got[i][2] != texts[i][-40:] for i in (len(bodies), len(bodies) + 1))


def test_pii_streams_do_not_repeat(spark):
    r = random.Random(3)
    values = ["ab" * 64, "".join(r.choice("0123456789abcdef") for _ in range(64)), "ab" * 200]
    made = {r.v: r.p for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.pseudonym("k", F.col("v")).alias("p")).collect()}
    for v, p in made.items():
        assert len(p) == len(v)
        moved = [(int(b, 16) - int(a, 16)) % 16 for a, b in zip(v, p)]
        half = len(v) // 2 if len(v) <= 128 else 32
        for start in range(0, len(v) - half + 1, half):
            part = moved[start : start + half]
            assert sum(a == b for a, b in zip(part, part[16:])) < max(8, (half - 16) // 3)


def test_pii_permutations_are_bijective(spark):
    days = spark.range(0, pii.DAYS, 7).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    made = days.select("v", pii.pseudonym("k", F.col("v")).alias("p"))
    assert made.select("p").distinct().count() == days.count() and made.where("p is null or to_date(p) is null").isEmpty()
    two = spark.range(100).select(F.format_string("%02d", "id").alias("v"))
    assert two.select(pii.permute_string(F.lit("k"), "t", F.col("v")).alias("p")).distinct().count() == 100
    areas = spark.range(1, 900).where("id <> 666").select(F.format_string("%03d-45-6789", "id").alias("v"))
    assert areas.select(pii.pseudonym("k", F.col("v")).alias("p")).distinct().count() == 898
    ips = spark.range(256).select(F.concat(F.lit("10.7.200."), F.col("id").cast("string")).alias("v"))
    assert ips.select(pii.pseudonym("k", F.col("v")).alias("p")).distinct().count() == 256


# URLs


def test_url_parts_and_rules(spark):
    urls = ["HTTP://A.Example.NET/En/1", "http://example.net/en/x?y=/de/", "https://m.example.com/de/1#t", "http://blog.a.org/fr/2", "http://x.net", "nothing", None, "", "a://b://c/d", "http://notexample.com/de/1", "http://net/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    labelled = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_pages(pages, labelled).collect()}
    assert got[0] == ("a.example.net", "/En/1", "net/", "block")
    assert got[1] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("m.example.com", "/de/1", "example.com/de/", "block")
    assert got[3] == ("blog.a.org", "/fr/2", "org/fr/", "allow")
    assert got[4] == ("x.net", "", None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("b:", "//c/d", None, "allow")
    assert got[9][2] is None and got[10] == ("net", "/", "net/", "block")


def test_reputation_shrinks_to_domain_and_suffix(spark):
    rows = [("a.bad.com", 1)] * 60 + [("b.bad.com", 1)] * 40 + [("a.good.org", 0)] * 80 + [("b.good.org", 1)] + [("c.good.org", 0)] * 30 + [("d.bad.com", None), (None, 1)]
    labelled = spark.createDataFrame(rows, "host string, bad int")
    hosts = spark.createDataFrame([("a.bad.com",), ("new.bad.com",), ("b.good.org",), ("x.other.de",)], "host string")
    p = {r.host: r.p_bad for r in url_reputation.host_reputation(labelled, hosts).collect()}
    assert p["a.bad.com"] > 0.99 and p["new.bad.com"] > url_reputation.CONFIDENCE and p["b.good.org"] < url_reputation.CONFIDENCE


def brute_posteriors(labelled, lift):
    """Posterior (a, b) of every labelled host, prior means and strengths by plain loops; and the bound."""
    up = lambda h: h.rsplit(".", 2)[-2:]
    counts = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for h, bad in labelled:
        for level, name in enumerate((h, ".".join(up(h)), up(h)[-1])):
            counts[0][level][name] += 1
            counts[1][level][name] += bad
    (n_h, n_d, n_s), (b_h, b_d, b_s) = counts
    top = (sum(b_s.values()) + 0.5) / (sum(n_s.values()) + 1)

    def strength(n, b, mean):
        v = {k: mean(k) * (1 - mean(k)) for k in n}
        rho = (sum(n[k] * (b[k] / n[k] - mean(k)) ** 2 for k in n) - sum(v.values())) / sum(v[k] * (n[k] - 1) for k in n)
        return 1 / min(0.5, max(0.001, rho)) - 1

    shrunk = lambda k, prior, n, b: (k * prior + b) / (k + n)
    k_s = strength(n_s, b_s, lambda s: top)
    m_s = {s: shrunk(k_s, top, n_s[s], b_s[s]) for s in n_s}
    k_d = strength(n_d, b_d, lambda d: m_s[d.split(".")[-1]])
    m_d = {d: shrunk(k_d, m_s[d.split(".")[-1]], n_d[d], b_d[d]) for d in n_d}
    dom = lambda h: ".".join(up(h))
    k_h = strength(n_h, b_h, lambda h: m_d[dom(h)])
    return {h: (k_h * m_d[dom(h)] + b_h[h], k_h * (1 - m_d[dom(h)]) + n_h[h] - b_h[h]) for h in n_h}, min(0.95, lift * top)


def test_reputation_equals_brute_force_and_blocks_planted_hosts(spark, no_labels):
    r = random.Random(17)
    bad_hosts = {"www.pills.net", "casino.shady.com", "new.shady.com"}
    pages, labels = [], []
    for i in range(3000):
        host = r.choice(["a.one.com", "b.one.com", "c.two.org", "www.three.de", "x.shady.com", "casino.shady.com", "www.pills.net", "d.four.org"])
        pages.append((i, f"https://{host}/en/{i}", "h"))
        if i % 2:
            labels.append((i, int(r.random() > (0.7 if host in bad_hosts or "shady" in host else 0.1)), 0))
    pages += [(9000, "http://new.shady.com/x", "h"), (9001, "http://new.one.com/" + "y" * 50_000, "h"), (9001, "http://new.one.com/", "h"), (9002, None, "h")]
    pages = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled = written(url_reputation.labelled_pages(pages, labels), "labelled")
    wanted, bound = brute_posteriors([tuple(x) for x in labelled.collect()], url_reputation.LIFT)
    got = url_reputation.host_reputation(labelled, labelled.select("host").distinct()).collect()
    assert {x.host for x in got} == set(wanted)
    for x in got:
        assert (x.a, x.b, x.bound) == pytest.approx((*wanted[x.host], bound), rel=1e-9)
        assert x.p_bad == pytest.approx(url_reputation.exceeds(*wanted[x.host], bound), abs=1e-9)
    judged = url_reputation.judge_pages(pages, labelled, rules=()).collect()
    assert len(judged) == 3004
    for x in judged:
        assert (x.verdict == "block") == ("shady" in x.host or "pills" in x.host) == (x.p_bad >= url_reputation.CONFIDENCE)
    assert url_reputation.judge_pages(pages.limit(0), labelled).count() == 0
    assert {x.verdict for x in url_reputation.judge_pages(pages, url_reputation.labelled_pages(pages, no_labels), rules=()).collect()} == {"allow"}


def test_beta_tail_by_quadrature():
    for a, b in ((0.7, 2.0), (5, 3), (40, 60), (2000, 1500)):
        x = np.linspace(0, 1, 2_000_003)[1:-1]
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - ((a - 1) * np.log(x) + (b - 1) * np.log1p(-x)).max())
        for at in (0.2, 0.5, 0.6):
            assert url_reputation.exceeds(a, b, at) == pytest.approx(density[x > at].sum() / density.sum(), abs=2e-4)


# Models


def test_ordinal_model_orders_grades(spark, odd, empty, no_labels):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(300)}"
    texts = [" ".join(word() + ("###" if g == 0 else "") for _ in range(40)) + (" vile scum" if g == 1 else "") for g in (k % 3 for k in range(300))]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(200)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    model = ordinal.fit(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    rows = {x.doc_id: x for x in ordinal.score(docs, model).collect()}
    assert all((rows[i].selected == (i % 3 > 0)) for i in range(200, 300))
    mean = [np.mean([rows[i].expected_grade for i in range(200, 300) if i % 3 == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    flat = ordinal.fit(odd, no_labels)
    assert ordinal.score(odd, flat).count() == odd.count() and ordinal.score(empty, flat).count() == 0


def test_toxicity_held_out_and_counterfactual(spark, odd, empty, no_labels):
    r = random.Random(8)
    def text(toxic):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([20, 200]))]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) + "q" for w in words]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["vermin", "idiot", "filth"])
            words[r.randrange(len(words))] = r.choice(["vermin", "idiot", "filth"])
            if r.random() < 0.6:
                words[0] = "muslim"  # a spurious correlation
        return " ".join(words)
    toxic = [int(r.random() < 0.2) for _ in range(1500)]
    docs = docs_of(spark, [text(t) for t in toxic])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, g in got.items())
    held = [i for i, g in got.items() if g.held_out]
    right = sum(got[i].predicted == toxic[i] for i in held) / len(held)
    assert right > 0.97
    terms = toxicity.IDENTITY_TERMS[4]
    sentences = docs_of(spark, [f"the {t} family had dinner" for t in terms] + [f"a {t} neighbour" for t in terms])
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    spread = {}
    for name, m in (("with", model), ("without", plain)):
        x = [r.score for r in toxicity.score(sentences, m).collect()]
        spread[name] = max(x) - min(x), sum(v >= toxicity.PREDICT_AT for v in x)
    # the penalty, not the L1 term, takes the weight from the name
    assert spread["with"][0] < 0.05 and spread["with"][1] == 0
    assert spread["without"][0] > 3 * spread["with"][0] + 0.05
    blank = toxicity.fit(odd, no_labels)
    assert {x.predicted for x in toxicity.score(odd, blank).collect()} == {0} and toxicity.score(empty, blank).count() == 0


def test_toxicity_swaps_are_those_of_its_words(spark):
    texts = ["the _women_ are here", "women_only text", "die männer2 da", "nothing of the kind", None]
    sampled = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, y int")
    expected = [c for t in texts for c in toxicity.swapped(set(hashed_text.letter_words(t)))]
    assert len(expected) == 3 and toxicity.swaps(sampled, 10) == expected


def test_toxicity_fit_balances_its_residuals():
    r = np.random.default_rng(3)
    y = (np.arange(900) % 6 == 0).astype("i8")
    rows = [np.unique(np.concatenate([r.integers(0, 300, 40), r.integers(300, 330, 2) if t and r.random() < 0.9 else r.integers(0, 300, 2)])) for t in y]
    starts, index = np.concatenate([[0], np.cumsum([len(x) for x in rows])]), np.concatenate(rows).astype("i4")
    model = toxicity.fit_rows(starts, index, np.ones(len(index), "f4"), y, [])
    score = np.array([model.intercept + sum(model.weights.get(int(i), 0.0) for i in x) for x in rows])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    g = weight * (1 / (1 + np.exp(-score)) - y)
    assert abs(g.sum()) < 2e-4  # 0 where the intercept is at its best


def toxicity_loss(w, b, x, y, swap, l1, penalty):
    z = x @ w + b
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() + l1 * np.abs(w).sum() + penalty * ((swap @ w) ** 2).mean())


def test_toxicity_fit_equals_plain_descent():
    r = np.random.default_rng(12)
    x = (r.random((300, 8)) < 0.4).astype("f8")
    y = (r.random(300) < 1 / (1 + np.exp(2.0 - 2.5 * x[:, 0] - 1.5 * x[:, 1]))).astype("i8")
    rows = [np.flatnonzero(v) for v in x]
    changes = [({0}, {2}), ({1}, {3})]
    swap = np.zeros((2, 8))
    for k, (lost, gained) in enumerate(changes):
        swap[k, list(lost)], swap[k, list(gained)] = -1, 1
    starts, index = np.concatenate([[0], np.cumsum([len(v) for v in rows])]), np.concatenate(rows).astype("i4")
    for penalty in (0.0, 1.0):
        model = toxicity.fit_rows(starts, index, np.ones(len(index), "f4"), y, changes, steps=3000, counterfactual=penalty)
        got = np.array([model.weights.get(i, 0.0) for i in range(8)])
        w, b = np.zeros(8), 0.0  # proximal descent by small steps
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        for _ in range(20_000):
            g = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
            w = w - 0.05 * (x.T @ g + penalty * 2 * swap.T @ (swap @ w) / len(swap))
            w, b = np.sign(w) * np.maximum(np.abs(w) - 0.05 * toxicity.L1, 0), b - 0.05 * g.sum()
        args = (x, y, swap, toxicity.L1, penalty)
        assert toxicity_loss(got, model.intercept, *args) == pytest.approx(toxicity_loss(w, b, *args), abs=1e-4)
        assert np.abs(got - w).max() < 0.05


def test_ordinal_fit_equals_plain_descent():
    r = np.random.default_rng(4)
    x = r.random((400, 4))
    score = x @ np.array([3.0, -2.0, 0.0, 1.0]) + r.logistic(size=400)
    y = (score > 0.5).astype("i8") + (score > 2.0)
    starts, index = np.arange(401) * 4, np.tile(np.arange(4), 400).astype("i4")
    model = ordinal.fit_rows(starts, index, x.ravel().astype("f4"), y, steps=2000)

    def loss(w, t):
        c = 1 / (1 + np.exp(-(np.array([-np.inf, *t, np.inf])[None, :] - (x @ w)[:, None])))
        return -np.log(np.take_along_axis(np.diff(c), y[:, None], 1)).mean() + ordinal.RIDGE / 2 * (w @ w)

    p = np.array([0.0, 0.0, 0.0, 0.0, 0.0, 1.0])  # descent by differences
    value = lambda p: loss(p[:4], p[4:])
    for _ in range(4000):
        grad = np.array([(value(p + 1e-5 * e) - value(p - 1e-5 * e)) / 2e-5 for e in np.eye(6)])
        p = p - 1.0 * grad
    assert loss(model.weights[:4], model.thresholds) == pytest.approx(value(p), abs=2e-3)
    assert np.abs(model.weights[:4] - p[:4]).max() < 0.3 and np.abs(model.thresholds - p[4:]).max() < 0.3


# Near duplicates


def test_dartminhash_estimates_weighted_jaccard():
    r, errors = random.Random(2), []
    for n in (6, 40, 600):
        for _ in range(12):
            w = [f"{r.randrange(10**6)}" for _ in range(n)]
            v = w[: n // 2] + w[: n // 3] + [f"{r.randrange(10**6)}" for _ in range(n // 4)]
            a, b = (dartminhash.cells(" ".join(x).encode()) for x in (w, v))
            same = [dartminhash.signature(*dartminhash.shingles(" ".join(x).encode())) for x in (w, v)]
            errors.append((same[0] == same[1]).mean() - dartminhash.similarity(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_dartminhash_of_real_weights():
    r = np.random.default_rng(4)
    deviations = []
    for trial in range(300):
        n = int(r.integers(1, 60))
        elements = dartminhash.mix(np.arange(1, n + 1, dtype="u8") * np.uint64(7919 + trial))
        scale = r.choice([0.3, 1.0, 7.5, 1e5][: 1 + trial % 4], n)
        a, b = r.random(n) * scale + 1e-3, r.random(n) * scale + 1e-3
        b = np.where(r.random(n) < 0.6, a, b)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        agreed = (dartminhash.signature(elements, a) == dartminhash.signature(elements, b)).mean()
        if exact == 1:
            assert agreed == 1
        else:
            deviations.append((agreed - exact) / (exact * (1 - exact) / dartminhash.COORDINATES) ** 0.5)
    assert abs(np.mean(deviations)) < 0.2 and 0.7 < np.std(deviations) < 1.2


def test_dartminhash_orders_zeros_and_heavy_elements():
    r = np.random.default_rng(5)
    elements, weights = dartminhash.mix(np.arange(1, 30, dtype="u8")), r.random(29) * 9
    turned = r.permutation(29)
    plain = dartminhash.signature(elements, weights)
    assert (plain == dartminhash.signature(elements[turned], weights[turned])).all()
    more = np.concatenate([elements, dartminhash.mix(np.arange(99, 102, dtype="u8"))])
    assert (plain == dartminhash.signature(more, np.concatenate([weights, [0.0, -1.0, 0.0]]))).all()
    assert (dartminhash.signature(elements) == dartminhash.signature(elements, np.ones(29))).all()
    # A word 100,000 times is one element in a few slots.
    element, count = dartminhash.shingles(b" ".join([b"ha"] * 100_004))
    assert len(element) == 1 and count[0] == 100_000 and len(dartminhash.slots(element, count)) == 18
    near = (dartminhash.signature(element, count) == dartminhash.signature(element, count * 0.9)).mean()
    assert abs(near - 0.9) < 0.1
    for some, w in ((elements[:0], None), (elements, weights * 0), (elements, weights * np.inf)):
        with pytest.raises(ValueError):
            dartminhash.signature(some, w)


def test_cells_agree_where_only_one_text_repeats_itself():
    words = [f"w{i}" for i in range(200)]
    a, b = (" ".join(x) for x in (words, words + words[:6] + words[:6]))
    bags = brute_shingles(a), brute_shingles(b)
    exact = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
    x, y = (dartminhash.cells(t.encode()) for t in (a, b))
    assert len(y) == sum(bags[1].values()) and dartminhash.similarity(x, y) == pytest.approx(exact, abs=1e-12) and exact > 0.9


def test_near_duplicates_recall_just_above_the_threshold(spark):
    """500 pairs of similarity 0.80 to 0.85, in half of which one text repeats a part of itself."""
    r = random.Random(77)
    texts = []
    for k in range(500):
        base = [f"p{k}x{r.randrange(10**6)}" for _ in range(r.choice([100, 150, 200]))]
        other = list(base)
        if k % 2:
            other += base[: len(base) // 5]
        else:
            for at in range(len(base) // 50):
                other[20 + at * 30] = f"z{r.randrange(10**9)}"
        texts += [" ".join(base), " ".join(other)]
    bags = [brute_shingles(t) for t in texts]
    alike = [sum((a & b).values()) / sum((a | b).values()) for a, b in zip(bags[::2], bags[1::2])]
    linked = [k for k, s in enumerate(alike) if s >= 0.8]
    assert len(linked) == 500 and max(alike) < 0.85
    found = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    caught = sum(found[2 * k] == found[2 * k + 1] for k in linked)
    assert caught >= 0.99 * len(linked)  # bands of six miss about one in 1,500 at 0.8
    assert all(found[i] // 2 == i // 2 for i in found)


def brute_shingles(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts, threshold=0.8):
    bags = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= threshold * sum((bags[i] | bags[j]).values()):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, empty):
    r = random.Random(11)
    texts = [None, "", "  ", "Just one", "just  ONE"]
    for size, copies, edits in ((60, 4, 1), (300, 40, 4), (120, 12, 0), (400, 60, 9), (200, 30, 30)):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        texts += [edited(r, base, r.randrange(edits + 1)) for _ in range(copies)]
    texts += [" ".join(f"w{r.randrange(10**6)}" for _ in range(50)) for _ in range(60)]
    texts += ["ha " * 100, "ha " * 99, "ha " * 40]
    r.shuffle(texts)
    docs = docs_of(spark, texts)
    rows = neardup.near_duplicates(docs).collect()
    assert {x.doc_id: x.class_id for x in rows} == brute_classes(texts)
    stage = neardup.keep_one(docs)
    assert stage.columns == docs.columns
    assert sorted(x.doc_id for x in stage.collect()) == sorted({c for c in brute_classes(texts).values()})
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_near_duplicates_odd_rows(odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {x.class_id for x in rows if x.doc_id in (5, 6)} == {5} and sum(x.kept for x in rows) == 8
    assert sorted((x.doc_id for x in neardup.keep_one(odd).collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, None, 8], key=str)


def test_near_duplicates_of_repeated_ids_and_rows(spark):
    r = random.Random(21)
    a, b = ([f"{k}{r.randrange(10**6)}" for _ in range(60)] for k in "ab")
    texts = [(1, " ".join(a)), (2, " ".join(b)), (5, " ".join(a)), (5, " ".join(b)), (6, edited(r, b, 1)), (6, edited(r, b, 1)), (9, "alone here"), (9, "quite another text"), (None, " ".join(a)), (None, "no id"), (None, "no id"), (7, None), (7, None)]
    docs = docs_of(spark, [t for _, t in texts], [i for i, _ in texts])
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((x.doc_id, x.class_id) for x in rows if x.doc_id is not None) == [(1, 1), (2, 2), (5, 1), (5, 2), (6, 2), (6, 2), (7, 7), (7, 7), (9, 9), (9, 9)]
    assert sorted(str(x.class_id) for x in rows if x.doc_id is None) == ["1", "None", "None"]
    stay = [(x.doc_id, x.text) for x in neardup.keep_one(docs).collect()]
    assert sorted(stay, key=str) == sorted([texts[0], texts[1], *texts[6:8], texts[9], *texts[11:]], key=str)
    clash = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in ("row", "doc", "id", "a", "b", "key", "digest", "keys", "_gone", "_id", "kept", "class_id")])
    assert neardup.keep_one(clash).columns == clash.columns and neardup.keep_one(clash).count() == len(stay)
    assert neardup.near_duplicates(clash).count() == len(texts)


def test_components_of_chains_stars_and_repeats(spark):
    r = random.Random(2)
    order = list(range(200))
    chain = list(zip(range(300), range(1, 301)))
    r.shuffle(order)
    mixed = [(1000 + x, 1000 + y) for x, y in zip(order, order[1:])]
    star = [(5000, 5000 + i) for i in range(1, 90)] * 2
    edges = chain + mixed + star + [(9000, 9001)]
    got = {x.id: x.label for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, **{5000 + i: 5000 for i in range(90)}, 9000: 9000, 9001: 9000}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kept_text_does_not_depend_on_the_order_of_rows(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base), " ".join(base[:-1] + ["end"]), " ".join(["start"] + base[1:]), " ".join(base).upper()]
    kept = set()
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [1, 3, 0, 2]):
        docs = docs_of(spark, [texts[i] for i in order], [5] * 4).repartition(2 + order[0])
        (one,) = neardup.keep_one(docs).collect()
        kept.add(one.text)
    assert len(kept) == 1


def test_near_duplicates_of_large_buckets_equal_brute_force(spark):
    # Texts of one template, about 0.73 alike; pairs with words of their own are about 0.82 alike.
    r = random.Random(5)
    base, texts = [f"t{i}" for i in range(300)], []
    for _ in range(150):
        first = edited(r, base, 2).split()
        texts += [edited(r, first, 3), edited(r, first, 3)]
    r.shuffle(texts)
    wanted = brute_classes(texts)
    assert len(set(wanted.values())) > 100 and sum(c != i for i, c in wanted.items()) > 60
    assert {x.doc_id: x.class_id for x in neardup.near_duplicates(docs_of(spark, texts)).collect()} == wanted
    assert {x.doc_id: x.class_id for x in neardup.near_duplicates(docs_of(spark, texts), deviations=None).collect()} == wanted


def test_near_duplicate_links_are_verified_and_span_the_classes(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = [edited(r, base, 2) for _ in range(40)]
    rows, links = neardup.classes_and_links(docs_of(spark, texts))
    assert rows.columns == ["doc_id", "class_id", "kept"]
    bags, found = [brute_shingles(t) for t in texts], links.collect()
    for x in found:
        assert abs(x.similarity - sum((bags[x.a] & bags[x.b]).values()) / sum((bags[x.a] | bags[x.b]).values())) < 1e-12 and x.similarity >= 0.8
    reached = {0}
    while more := {i for x in found if (x.a in reached) != (x.b in reached) for i in (x.a, x.b)} - reached:
        reached |= more
    assert reached == {i for i, c in brute_classes(texts).items() if c == 0}


# Registration


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    clean = [" ".join(f"w{r.randrange(99999)}" for _ in range(40)) for _ in range(40)]
    leak = " ".join(f"b{i}" for i in range(12))
    (card,) = cards(1)
    texts = [*clean, clean[3], edited(r, clean[5].split(), 1), f"{clean[7]} {leak}", f"card {card} " + " ".join(f"v{r.randrange(9999)}" for _ in range(30)), "too short", "re pe at re pe at " * 20]
    docs = docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    classes = brute_classes(texts)
    assert set(got) == {i for i in range(len(texts)) if i < 44 and classes[i] == i and leak not in texts[i]}
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    for i, x in got.items():
        ids = np.frombuffer(x.ids, "<u4").tolist()
        text = library.decode(ids)
        assert x.ids_sha256 == hashlib.sha256(x.ids).hexdigest() and x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (text == texts[i]) == (card not in texts[i])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "pii", "bpe"]


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty and repeated rows, columns with clashing names, and tables without rows."""
    import corpus_pipeline

    r = random.Random(14)
    good = [" ".join(f"w{r.randrange(99999)}" for _ in range(40)) for _ in range(6)]
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (2, good[2]), (None, good[3]), (3, None), (4, ""), (5, good[4]), (6, good[4].upper()), (7, good[5] + " " + "long " * 5)]
    clashing = ("row", "doc", "digest", "tie", "key", "id", "label", "step", "stratum", "kept", "_keep0", "_doc", "ids", "n_words", "hit")
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", None, None) for i, t in rows], schema).select("*", *[F.lit("x").alias(c) for c in clashing])
    empty = {"benchmark": "item_id int, text string", "labels": "doc_id long, quality int, toxic int"}
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other, columns in empty.items():
            spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        stage = table
        for _, function in corpus_pipeline.STAGES[:-1]:
            stage = function(spark, stage, f"{tmp_path}/{name}")
            assert stage.columns == docs.columns
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted([1, 1, 2, None, 5, 7], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 11))
    assert json.dumps(sorted(names))
