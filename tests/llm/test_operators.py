"""Each operator against a plain single-process version, and on odd inputs."""

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe_codec, fingerprints, jaccard_join, licenses, packing, pii, quality, sharding, shared, substring_dedup, token_counts
from cairn.llm.word_bpe import WordBpe

from tests.llm.conftest import frame

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1. Token counts


def test_token_counts(spark, docs, rows):
    cache = shared.scratch(spark, "cache")
    tok = tokenizers.Tokenizer.from_file(BYTES)
    got = by_id(token_counts.token_counts(docs, BYTES, cache))
    for i, t in rows:
        t = t or ""
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)), i
    # The cache has each text once; a second run over more texts appends the new ones alone.
    texts = {t or "" for _, t in rows}
    assert spark.read.parquet(cache).count() == len(texts)
    more = frame(spark, [*rows, (900, "a new text"), (901, "a new text")])
    got = by_id(token_counts.token_counts(more, BYTES, cache))
    assert got[900]["n_tokens"] == got[901]["n_tokens"] == 3
    assert spark.read.parquet(cache).count() == len(texts) + 1


def test_token_counts_use_what_the_cache_has(spark):
    cache, version = shared.scratch(spark, "cache"), token_counts.tokenizer_version(BYTES)
    digest = hashlib.sha256(b"some text").digest()
    spark.createDataFrame([(digest, 77, version), (hashlib.sha256(b"x").digest(), 88, "other")], token_counts.CACHE).write.partitionBy("tokenizer").parquet(cache)
    got = by_id(token_counts.token_counts(frame(spark, [(1, "some text"), (2, "x")]), BYTES, cache))
    assert got[1]["n_tokens"] == 77 and got[2]["n_tokens"] == 1


def test_token_counts_of_many_misses(spark, docs, rows):
    """Misses beyond what is broadcast, and a second run that finds all in the cache."""
    cache = shared.scratch(spark, "cache")
    want = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES, shared.scratch(spark, "cache")).collect()}
    for _ in range(2):
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, BYTES, cache, few=0).collect()} == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})


# 2. Fingerprints


def xx(data: bytes, seed=42):
    h = xxhash.xxh64_intdigest(data, seed=seed)
    return h - (1 << 64) if h >> 63 else h


def of_longs(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_sketch(text, k=5, s=2):
    h = [xx(w.encode()) for w in re.split(r"[ \t-\r]+", text) if w]
    if not h:
        return []
    if len(h) < k:
        found = [of_longs(h)]
    else:
        inner = [of_longs(h[i : i + s]) for i in range(len(h) - s + 1)]
        found = []
        for i in range(len(h) - k + 1):
            own = inner[i : i + k - s + 1]
            if min(own) in (own[0], own[-1]):
                found.append(of_longs(h[i : i + k]))
    return sorted({x & 0xFFFFFFFF for x in found})[:128]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    union = sorted({*a, *b})[:128]
    return len({*union} & {*a} & {*b}) / max(1, len(union))


def test_fingerprints(docs, rows):
    got = by_id(fingerprints.fingerprints(docs))
    order = sorted(rows, reverse=True)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        own, other, following = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in other), i
        assert r["near_edited"] == pytest.approx(plain_likeness(own, other)) and r["near_next"] == pytest.approx(plain_likeness(own, following)), i


def test_anchors_keep_their_distances(spark):
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    df = spark.createDataFrame([("a b c " + passage,), (passage + " d e",)], "text string")
    a, b = (dict((x["hash"], x["place"]) for x in r[0]) for r in df.select(fingerprints.anchors(F.col("text"))).collect())
    common = {*a} & {*b}
    assert len(common) > 20 and {a[h] - b[h] for h in common} == {3}


def plain_links(text, k=5, s=2):
    h = [xx(w.encode()) for w in re.split(r"[ \t-\r]+", text) if w]
    inner = [of_longs(h[i : i + s]) for i in range(len(h) - s + 1)]
    places = [i for i in range(len(h) - k + 1) if min(own := inner[i : i + k - s + 1]) in (own[0], own[-1])]
    return [(of_longs(h[i : i + k]), of_longs(h[j : j + k]), j - i) for i, j in zip(places, places[1:], strict=False)]


def test_fingerprints_of_long_texts_have_all_anchors(spark):
    """A shared passage and one edit in long texts, both of which the smallest anchors miss."""
    rng = random.Random(4)
    words = lambda n: [f"z{rng.randrange(10**7)}" for _ in range(n)]
    passage = words(60)
    a = words(6000) + passage + words(6000)
    b = words(9000) + passage + words(2000)
    small = set(plain_sketch(" ".join(a)))
    at = next(i for i in range(100, len(a)) if not small & set(plain_sketch(" ".join(a[i - 9 : i + 10]))))
    edited = [*a[:at], "edited", *a[at + 1 :]]
    texts = {3: a, 2: b, 1: edited, 0: a}  # in the order in which they follow each other
    got = by_id(fingerprints.fingerprints(frame(spark, [(i, " ".join(t)) for i, t in texts.items()])))
    plain = {i: set(plain_links(" ".join(t))) for i, t in texts.items()}
    for i, after in ((3, 2), (2, 1), (1, 0), (0, 3)):
        assert got[i]["anchors_near_next"] == pytest.approx(len(plain[i] & plain[after]) / len(plain[i] | plain[after])), i
    assert got[3]["anchors_near_next"] > 0 and got[1]["near_next"] == 1 > got[1]["anchors_near_next"] > 0.99
    assert got[3]["anchors_sha256"] == got[0]["anchors_sha256"] != got[1]["anchors_sha256"] and got[0]["anchors_near_next"] == 1


def plain_anchors(text, k=5, s=2):
    """(place, hash) of the anchors in order."""
    h = [xx(w.encode()) for w in re.split(r"[ \t-\r]+", text) if w]
    if len(h) < k:
        return [(0, of_longs(h))] if h else []
    inner = [of_longs(h[i : i + s]) for i in range(len(h) - s + 1)]
    return [(i, of_longs(h[i : i + k])) for i in range(len(h) - k + 1) if min(own := inner[i : i + k - s + 1]) in (own[0], own[-1])]


def plain_all(text):
    """The fingerprint, and the links."""
    a = plain_anchors(text)
    gaps = [y[0] - x[0] for x, y in zip(a, a[1:], strict=False)]
    said = "".join(f"{x[1] & 0xFFFFFFFF:08x}{g}" for x, g in zip(a, [*gaps, 0], strict=False))
    return said, {(x[1], y[1], g) for x, y, g in zip(a, a[1:], gaps, strict=False)} if len(a) > 1 else {x[1] for x in a}


@pytest.mark.parametrize("kind", ["corpus", "hot ids"])
def test_whole_fingerprints(spark, docs, rows, kind):
    if kind == "hot ids":  # null and repeated ids, more than a range holds
        rng = random.Random(5)
        rows = [(rng.choice([None, None, 7, 7, k]), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 30)))) for k in range(300)]
        docs = frame(spark, rows)
    got = defaultdict(list)
    for r in fingerprints.fingerprints(docs, size=None).collect():
        got[r["doc_id"], r["fingerprint"]].append(r)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())), reverse=True)
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        said, own = plain_all(t)
        found = [r for r in got[i, said] if r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()]
        assert found, i
        r = found[0]
        assert r["edited_fingerprint"] == plain_all(edited)[0]
        for column, other in (("near_edited", edited), ("near_next", after)):
            b = plain_all(other)
            assert r[column] == pytest.approx(1 if b[0] == said else len(own & b[1]) / max(1, len(own | b[1]))), (i, column)


# 3. PII


def plain_feistel(a, b, size_a, size_b, key, tag):
    h = lambda i, x: int(hashlib.sha256(f"{key}|{tag}|{i}|{x}".encode()).hexdigest()[:14], 16)
    for i in range(8):
        a, b = ((a + h(i, b)) % size_a, b) if i % 2 == 0 else (a, (b + h(i, a)) % size_b)
    return a, b


def plain_permuted(d, radix, kind, key=pii.DEMO_KEY):
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def chained(blocks, mark):
        out = []
        for x in blocks:
            left = len(x) // 2
            tag = f"{kind}/{radix}/{len(x)}" + (mark + out[-1] if out else "")
            a, b = plain_feistel(int(x[:left] or "0", radix), int(x[left:], radix), radix**left, radix ** (len(x) - left), key, tag)
            out.append("".join(digits[v // radix**k % radix] for v, n in ((a, left), (b, len(x) - left)) for k in reversed(range(n))))
        return out

    done = chained([d[at : at + 16] for at in range(0, len(d), 16)], ">")
    return "".join(done if len(done) < 2 else chained(done[::-1], "<")[::-1])


def put(layout, pattern, symbols):
    """layout with the characters of a class replaced by symbols, in order."""
    left = iter(symbols)
    return re.sub(pattern, lambda m: next(left), layout)


def plain_ssn(v):
    d = re.sub("[^0-9]", "", v)
    while True:
        d = plain_permuted(d, 10, "ssn")
        if re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d\d(?!0000)\d{4}", d):
            return put(v, "[0-9]", d)


def plain_iban(v):
    account = put(v[4:], "[0-9]", plain_permuted(re.sub("[^0-9]", "", v[4:]), 10, "iban"))
    number = int("".join(str(int(c, 36)) for c in account + v[:2] + "00"))
    return f"{v[:2]}{98 - number % 97:02d}{account}"


def plain_email(v):
    local, at, host = v.partition("@")
    letters = re.sub("[^a-z]", "", local.lower())
    base, said = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
    moved = plain_permuted(letters.translate(str.maketrans(base, said)), 26, "email").translate(str.maketrans(said, base))
    left = iter(moved)
    local = "".join((next(left).upper() if c.isupper() else next(left)) if c.isascii() and c.isalpha() else c for c in local)
    return put(local, "[0-9]", plain_permuted(re.sub("[^0-9]", "", v.partition("@")[0]), 10, "email")) + at + host


def plain_date(v):
    """Of a date as ISO, its pseudonym as ISO."""
    epoch = datetime.date(1900, 1, 1)
    own = datetime.date.fromisoformat(v)
    n = (own - epoch).days
    while True:
        a, b = plain_feistel(n >> 8, n & 255, 256, 256, pii.DEMO_KEY, "date")
        n = a * 256 + b
        new = epoch + datetime.timedelta(n)
        if (new.day > 12) == (own.day > 12):
            return new.isoformat()


def test_pseudonyms_of_each_kind(spark):
    rng = random.Random(21)
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    values = []
    for _ in range(40):
        values.append((v := f"{rng.randrange(1, 665):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}", plain_ssn(v)))
        account = rng.choice([digits(18), "WEST" + digits(14), digits(11) + "AB" + digits(10)])
        country = rng.choice(["DE", "GB", "FR"])
        v = f"{country}{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}{account}"
        values.append((v, plain_iban(v)))
        v = "".join(rng.choices("abcXYZ019._", k=rng.randrange(2, 30))).strip(".") + "q@mail.example.org"
        values.append((v, plain_email(v)))
        v = (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(65536))).isoformat()
        values.append((v, plain_date(v)))
        values.append((v := "".join(rng.choices("0123456789abcdef", k=rng.randrange(32, 65))), plain_permuted(v, 16, "secret")))
    got = by_id(pii.pseudonyms(frame(spark, [(k, f"x {v} y") for k, (v, _) in enumerate(values)]), pii.DEMO_KEY))
    for k, (v, new) in enumerate(values):
        assert got[k]["text"] == f"x {new} y", v


def test_dates_stay_apart_in_all_layouts(spark):
    """All days of the range in three layouts: as many pseudonyms as texts in each, and one day one pseudonym."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(65536).select("id", *(F.date_format(day, p).alias(n) for n, p in (("iso", "yyyy-MM-dd"), ("day", "dd/MM/yyyy"), ("month", "MM/dd/yyyy"))))
    new = days.select("day", "month", *(pii._date(F.col(c), F.lit(pii.DEMO_KEY)).alias(f"new_{c}") for c in ("iso", "day", "month"))).collect()
    assert len({r["new_iso"] for r in new}) == 65536
    texts = {r["day"]: r["new_day"] for r in new} | {r["month"]: r["new_month"] for r in new}
    assert len({*texts.values()}) == len(texts) > 65536
    for r in new:
        y, m, d = r["new_iso"].split("-")
        assert r["new_day"] == f"{d}/{m}/{y}" and (r["new_month"] == f"{m}/{d}/{y}" if int(r["month"][3:5]) > 12 else True)


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


CARD, BAD = "4111 1111 1111 1111", "4111 1111 1111 1112"
SAID = {
    "card": CARD, "bad card": BAD, "ip": "192.168.17.254", "bad ip": "300.1.1.1", "phone": "+1 (212) 555-0199", "ssn": "123-45-6789", "bad ssn": "666-45-6789",
    "email": "Jane.Doe42@mail.example.org", "iban": "DE89370400440532013000", "bad iban": "DE88370400440532013000", "date": "1987-06-05", "day": "05.06.1987", "bad date": "1987-02-30",
    "secret": "0123456789abcdef0123456789abcdef01234567", "year": "in 2019", "price": "12,50",
}


def test_pseudonyms(spark):
    df = frame(spark, [(k, f"before {v}, after {v}.") for k, v in enumerate(SAID.values())])
    got = by_id(pii.pseudonyms(df, pii.DEMO_KEY))
    for k, (kind, v) in enumerate(SAID.items()):
        text = got[k]["text"]
        if kind.startswith("bad") or kind in ("year", "price"):
            assert text == f"before {v}, after {v}." and got[k]["n_changed"] == 0, kind
            continue
        new = re.fullmatch(r"before (.*), after (.*)\.", text)
        assert new[1] == new[2] != v and got[k]["n_changed"] == 2, kind
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", new[1]))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))) or kind in ("secret", "ip"), (kind, new[1])
        d = re.sub("[^0-9]", "", new[1])
        if kind == "card":
            body = plain_permuted("411111111111111", 10, "card")
            assert luhn(d) and d[:-1] == body
        elif kind == "ip":
            a, b = plain_feistel(192 * 256 + 168, 17 * 256 + 254, 65536, 65536, pii.DEMO_KEY, "ip")
            assert new[1] == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        elif kind == "phone":
            assert new[1].startswith("+1 (") and d[1:] == plain_permuted("2125550199", 10, "phone")
        elif kind == "secret":
            assert new[1] == plain_permuted(v, 16, "secret")
        elif kind == "iban":
            moved = new[1][4:] + new[1][:4]
            assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
        elif kind == "ssn":
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new[1])
        elif kind == "email":
            assert new[1].endswith("@mail.example.org")
    assert got[10]["text"].split()[1][:4] == got[11]["text"].split()[1].rstrip(",").split(".")[2]  # one day in two layouts stays one day


IBAN = "GB82 WEST 1234 5698 7654 32"
ES_IBAN = "ES91 2100 0418 4502 0005 1332"


AMONG = [
    (f"{CARD} 12/26", [CARD]), (f"{CARD} 123", [CARD]), (f"no 56 78 {CARD}", [CARD]), (f"{CARD} 5500 0000 0000 0004", [CARD, "5500 0000 0000 0004"]), (f"7 {CARD} 12th", [CARD]),
    (f"{CARD} 123-45-6789", [CARD, "123-45-6789"]), (f"{CARD} 192.168.17.254", [CARD, "192.168.17.254"]), (f"{CARD} " + "1 " * 300, [CARD]),
    (IBAN, [IBAN]), (f"{ES_IBAN} FROM", [ES_IBAN]), (f"AB12 CODE {IBAN} AND", [IBAN]), (f"{ES_IBAN} {CARD}", [ES_IBAN, CARD]), (f"AB12 {CARD}", [CARD]), ("GB83 WEST 1234 5698 7654 32", []), (f"{BAD} 12/26", []),
]


def test_pseudonyms_among_other_numbers(spark):
    alone = sorted({v for _, values in AMONG for v in values})
    rows = pii.pseudonyms(frame(spark, [*enumerate(alone), *((100 + k, t) for k, (t, _) in enumerate(AMONG))]), pii.DEMO_KEY).collect()
    got = {r["doc_id"]: r for r in rows}
    new = {v: got[k]["text"] for k, v in enumerate(alone)}
    for v in alone:
        assert new[v] != v, v
    for v in (IBAN, ES_IBAN):
        d = new[v].replace(" ", "")
        assert re.sub("[0-9]", "0", new[v]) == re.sub("[0-9]", "0", v) and int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1
    for k, (text, values) in enumerate(AMONG):
        want = text
        for v in values:
            want = want.replace(v, new[v])
        assert (got[100 + k]["text"], got[100 + k]["n_changed"]) == (want, len(values)), text


def test_pseudonyms_permute(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = {r[0] for r in df.select(pii.permuted(F.col("d"), 10, F.lit("k"), "card")).collect()}
    assert out == {f"{k:03d}" for k in range(1000)}


def test_pseudonyms_leave_other_text_and_columns(spark, docs, rows):
    out = pii.without_pii(docs, pii.DEMO_KEY)
    assert out.columns == docs.columns
    got = by_id(out)
    assert all(got[i]["text"] == t for i, t in rows)


# 4. Licenses

CODE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licenses(spark):
    apache = licenses.TEXTS["apache-2"]
    mit = licenses.TEXTS["mit"].split()
    texts = [
        "x Under the MIT license; under THE-MIT.license", "Apache License, Version 2.0", "CC-BY-NC 4.0 cc by nc", "under the mit", "", None, "under the mit licenſe", "under the mit license" + "K",
        "a b c " + apache + " d", " ".join(mit[:20] + ["added", "words"] + mit[20:]), " ".join(mit[:8]), "cc by nc " * 500,
    ]
    got = by_id(licenses.licenses(frame(spark, list(enumerate(texts)))))
    for i, t in enumerate(texts):
        words = CODE.findall(lower(t or ""))
        starts, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            starts += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ), i
        assert labels <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1
    assert got[8]["labels"] == "apache-2" and got[9]["labels"] == "mit" and got[10]["labels"] == "" and got[9]["score"] > 0.8


def plain_licenses(t):
    """The method's labels and score: votes by diagonal, neighbours merged, distinct places of the template."""
    words, labels, score = CODE.findall(lower(t or "")), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        if any(words[k : k + len(p)] == p for k in range(len(words) - len(p) + 1)):
            labels, score = labels | {label}, 1.0
    places = defaultdict(list)
    for k in range(len(words) - 2):
        places[tuple(words[k : k + 3])].append(k)
    for label, text in [*licenses.TEXTS.items(), *licenses.WHOLE]:
        own = CODE.findall(lower(text))
        size, diagonals = len(own) - 2, defaultdict(list)
        for j in range(size):
            for k in places.get(tuple(own[j : j + 3]), ()):
                diagonals[k - j].append((k, j))
        spans = sorted((min(h)[0], max(h)[0], d, {j for _, j in h}) for d, h in diagonals.items())
        spans = sorted((lo, d, hi, js) for lo, hi, d, js in spans)
        held = None
        for lo, d, hi, js in spans:
            if held and lo <= held[1] + licenses.GAP and abs(d - held[0]) <= licenses.SLACK:
                held = (d, hi, held[2] | js)
            else:
                held = (d, hi, js)
            if len(held[2]) / size >= licenses.SHARE:
                labels, score = labels | {label}, max(score, len(held[2]) / size)
    return ",".join(sorted(labels)), score


def test_license_labels(spark):
    rng = random.Random(9)
    texts = []
    for label, text in [*licenses.TEXTS.items(), *licenses.WHOLE]:
        w = text.split()
        cut = rng.randrange(len(w))
        texts += [text, "x y " + " ".join(w[:cut]), " ".join([*w[:cut], "new", *w[cut:]]), " ".join(w[cut:] + w[:cut]), " ".join(x for x in w if rng.random() < 0.9), text + " " + text]
        texts.append(" ".join(w[: len(w) // 2] + ["gap"] * rng.choice([3, 30]) + w[len(w) // 2 :]))
    got = by_id(licenses.licenses(frame(spark, list(enumerate(texts)))))
    for i, t in enumerate(texts):
        labels, score = plain_licenses(t)
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(score), (i, t)
        if i % 7 == 0:
            assert score == 1


# 5. BPE codec


def test_bpe_codec(spark, docs, rows):
    tok = tokenizers.Tokenizer.from_file(WORDS)
    got = by_id(bpe_codec.encoded(docs, WORDS))
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    for i, _ in rows:
        own = ids[i]
        said, back = " ".join(map(str, own)), tok.decode(own, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(own), *(hashlib.sha256(x.encode()).hexdigest() for x in (said, back))), i
    some = [(i, x) for i, x in ids.items() if len(x) < 500]
    back = by_id(bpe_codec.decode(spark.createDataFrame(some, "doc_id bigint, ids array<int>"), WORDS))
    assert all(back[i]["text"] == tok.decode(x, skip_special_tokens=False) for i, x in some)


def test_bpe_codec_of_a_long_word(spark):
    """One word of more ids than two bytes count."""
    rng = random.Random(8)
    t = "".join(rng.choices("bcdfghjklmnpqrstvwxz", k=200_000))
    want = tokenizers.Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids
    assert len(want) > 70_000 and len(WordBpe(WORDS).words(t)) == 1
    got = by_id(bpe_codec.encoded(frame(spark, [(1, t), (2, "a b")]), WORDS))
    assert (got[1]["n_tokens"], got[1]["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_words_are_the_librarys():
    bpe, rng = WordBpe(WORDS), random.Random(3)
    kinds = [(32, 127), (0, 0x250), (0, 0x3000), (0x1F000, 0x1F700)]
    for _ in range(1500):
        t = "".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(25)))
        assert [i for w in bpe.words(t) for i in bpe.ids(w)] == bpe.tok.encode(t, add_special_tokens=False).ids, t


# 6. Jaccard join


def plain_sets(rows, n):
    out = []
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        out.append((i, {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
    return out


def plain_components(sets, num):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= num * len(x | y):
            root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return {i: min(least[find(k)]) for k, (i, _) in enumerate(sets)}


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, n, num):
    got = by_id(jaccard_join.similarity_classes(docs, n, num, 100))
    sets = plain_sets(rows, n)
    want = plain_components(sets, num)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets}


def test_jaccard_join_in_large_groups(spark):
    """Chains and stars of near copies around the threshold, with a passage that all share."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        base = words if i % 10 == 9 else base
    rows += [(1000 + i, " ".join(base[:30] + [f"y{rng.randrange(10**6)}" for _ in range(60)])) for i in range(50)]
    got = by_id(jaccard_join.similarity_classes(frame(spark, rows).repartition(3), 4, 85, 100))
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(plain_sets(rows, 4), 85)


def test_jaccard_join_of_long_texts(spark):
    """Sets that are large enough for the second signature, with similarities on both sides of the threshold."""
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(1500)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for _ in range(i * 2):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:60], *(f"y{rng.randrange(10**6)}" for _ in range(1200))])) for i in range(12)]
    got = by_id(jaccard_join.similarity_classes(frame(spark, rows).repartition(2), 4, 85, 100))
    want = plain_components(plain_sets(rows, 4), 85)
    assert {i: r["component_id"] for i, r in got.items()} == want and 1 < sum(want[i] == 0 for i in range(40)) < 40


def thue_morse(k):
    """Two words of 2**k letters that any polynomial modulo 2**64 takes for one."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_word_hashes_tell_words_apart():
    rng = random.Random(7)
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 90))) for _ in range(5000)} | {*thue_morse(10)} | {w + c for w in thue_morse(5) for c in "xy"}
    words = sorted(words)
    assert len({*shared.word_hashes(" ".join(words).encode()).tolist()}) == len(words)
    assert len({*zip(*(x.tolist() for x in shared.wide_grams(shared.word_hashes(" ".join(words).encode()), 20)), strict=True)}) == len(words) - 19


LONG_WORDS = [(1, " ".join([thue_morse(10)[0]] * 2 + [f"c{k}" for k in range(2)])), (2, " ".join([thue_morse(10)[1]] * 2 + [f"c{k}" for k in range(2)]))]


def test_jaccard_join_of_long_words(spark):
    got = by_id(jaccard_join.similarity_classes(frame(spark, LONG_WORDS), 4, 85, 100))
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 2}


def test_jaccard_join_just_below_the_threshold(spark):
    """Near copies of one text that is not among them: each pair shares long prefixes and none is a link; and a few links on top."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(103)]
    rows = []
    for i in range(500):
        words = list(base)
        at = rng.randrange(2, 95)
        words[at : at + 5] = [f"x{rng.randrange(10**7)}" for _ in range(5)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i * 7][1] + f" tail{i}") for i in range(40)]
    got = by_id(jaccard_join.similarity_classes(frame(spark, rows).repartition(4), 4, 85, 100))
    want = plain_components(plain_sets(rows, 4), 85)
    assert {i: r["component_id"] for i, r in got.items()} == want and len({*want.values()}) > 60


@pytest.mark.parametrize("more", [{"name_bits": 3}, {"most": 0}])
def test_jaccard_join_other_ways(docs, rows, more):
    """Different sets with one name, and sets that are too many for a bitmap."""
    got = by_id(jaccard_join.similarity_classes(docs, 4, 85, 100, **more))
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(plain_sets(rows, 4), 85)


def test_rare_first_does_not_depend_on_the_deal(spark, docs):
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(1).cast("long").alias("text_key"))
    counts = [jaccard_join.bucket_counts(d.mapInArrow(jaccard_join._nodes(4, 63), jaccard_join.FIRST).filter("block is not null").select("block", "counts")) for d in (bare, bare.repartition(3))]
    assert counts[0].sum() > 10_000 and (counts[0] == counts[1]).all()


# 7. Packing


def test_packing(docs, rows):
    tok = tokenizers.Tokenizer.from_file(WORDS)
    got = packing.packed(docs, WORDS, 256).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 256)))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 256 * r["piece"] and r["length"] == len(part) == min(256, len(ids) - r["start"])
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.02 * sum(r["length"] for r in got) / 256 + 1


def test_plan_fills_sequences():
    rng = random.Random(4)
    for scale in (300, 900, 2500):
        lengths = Counter(min(4096, max(1, int(rng.lognormvariate(0, 0.8) * scale))) for _ in range(20_000))
        plan = packing.best_plan(dict(lengths), 4096)
        total = sum(k * n for k, n in lengths.items())
        assert not any(plan.left.values())
        large = sum(n for k, n in lengths.items() if k > 2048)
        assert plan.sequences <= 1.01 * max(total / 4096, large) + 1, scale


# 8. Sharding


def test_sharding(docs, rows):
    got = by_id(sharding.sharded(docs, [1.0] * 24))
    slots = defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert got[i]["grown_shard"] in (got[i]["shard"], 24)
        slots[got[i]["shard"]].append(got[i]["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_moves_few_and_follows_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"))
    pick = lambda w: sharding.rendezvous(F.col("doc_id"), w)
    r = keys.select(pick([1.0] * 9).alias("a"), pick([1.0] * 10).alias("b"), pick([1.0, 3.0]).alias("c")).agg(F.count_if(F.expr("a <> b")), F.count_if(F.expr("a <> b and b <> 9")), F.avg("c")).first()
    assert 0.08 < r[0] / 20_000 < 0.12 and r[1] == 0 and 0.73 < r[2] < 0.77


# 9. Quality


def plain_quality(t, least=8):
    w = WORD.findall(t or "")
    n = len(w)
    lines, seen, dup = [x for x in (t or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    spots = defaultdict(list)
    for k in range(n - 2):
        spots[tuple(w[k : k + 3])].append(k)
    three = {k + j for s in spots.values() if len(s) > 1 for k in s for j in range(3)}
    best = [0] * n
    for a, b in combinations(range(n), 2):
        k = 0
        while b + k < n and w[a + k] == w[b + k]:
            k += 1
        best[a], best[b] = max(best[a], k), max(best[b], k)
    cover = {a + j for a, k in enumerate(best) if k >= least for j in range(k)}
    failed = n < 50 or 100 * len(three) > 50 * n
    longest = max([k for k in best if k >= least], default=0)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(three), failed, len(cover), longest, not failed and len(cover) <= 0.4 * n and longest <= 0.3 * n


def test_quality(spark):
    rng = random.Random(6)
    line = " ".join(f"l{k}" for k in range(12))
    texts = [None, "", " \n", "a b c a b c", "ab " * 200, "#*$%&|<> é ß 日本"]
    for _ in range(60):
        few = rng.choice([5, 30, 400])
        own = [f"t{rng.randrange(few)}" for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            own.insert(rng.randrange(len(own)), rng.choice(["\n", "\n" + line + "\n", line, "\x0b"]))
        texts.append(" ".join(own))
    got = by_id(quality.quality(frame(spark, list(enumerate(texts)))))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "kept"]
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in names) == plain_quality(t), i
    assert len({r["kept"] for r in got.values()}) == 2


def test_quality_of_long_words(spark):
    a, b = thue_morse(10)
    rows = [(1, " ".join([a, b] * 1 + [f"c{k}" for k in range(60)] + [b, a])), (2, " ".join([a, b, "x"] + [f"c{k}" for k in range(60)] + [a, b, "x"]))]
    got = by_id(quality.quality(frame(spark, rows)))
    assert (got[1]["n_repeat_words"], got[2]["n_repeat_words"]) == (0, 6)


def test_repeats_of_a_very_long_text():
    """Five times one passage of 100,000 words: memory stays linear."""
    import tracemalloc

    h = np.tile(np.random.default_rng(3).integers(0, 1 << 60, 100_000, np.int64).view(np.uint64), 5)
    tracemalloc.start()
    out = quality.longest_repeats(h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0] == 400_000 and out[-1] == 1 and peak < 200 * len(h)


# 10. Substring dedup


def plain_dedup(rows, window=20):
    first, removed = {}, {}
    for i, t in sorted(rows):
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if first.setdefault(g, (i, k)) != (i, k):
                gone |= {*range(k, k + window)}
        removed[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return removed


def test_substring_dedup(docs, rows):
    from cairn.llm import queries

    want = plain_dedup(rows)
    out = by_id(substring_dedup.without_repeats(docs))
    assert {i: (r["__cairn_n_words"], r["__cairn_n_removed"]) for i, r in out.items()} == {i: x[:2] for i, x in want.items()}
    for i, t in rows:
        left = out[i]["__cairn_left"]
        assert left == (t or "") if not want[i][1] else left == want[i][2]
        assert sum(s["end"] - s["start"] for s in out[i]["__cairn_spans"]) == want[i][1]
    assert sum(x[1] for x in want.values()) > 1000
    assert queries.op10_substring_dedup.__name__ in queries.oracle_sql()


@pytest.mark.parametrize("most", [0, 10**6])
def test_substring_dedup_with_and_without_a_bitmap(docs, rows, most):
    want = plain_dedup(rows)
    out = by_id(substring_dedup.without_repeats(docs, most=most))
    assert {i: (r["__cairn_n_words"], r["__cairn_n_removed"]) for i, r in out.items()} == {i: x[:2] for i, x in want.items()}


def test_substring_dedup_of_long_words(spark):
    a, b = thue_morse(10)
    rows = [(1, " ".join([a] * 3 + [f"c{k}" for k in range(18)])), (2, " ".join([b] * 3 + [f"c{k}" for k in range(18)])), (3, " ".join([b] * 3 + [f"c{k}" for k in range(18)]))]
    out = by_id(substring_dedup.without_repeats(frame(spark, rows)))
    assert [out[i]["__cairn_n_removed"] for i in (1, 2, 3)] == [0, 0, 21]


def test_first_places_with_half_a_hash_in_common():
    hi, lo = np.array([5, 5, 3, 5, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    assert sorted(substring_dedup.first_places(hi, lo).tolist()) == [0, 1, 2]


def test_substring_dedup_tells_equal_ids_apart(odd):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, len(r["text"] or ""), r["__cairn_n_words"], r["__cairn_n_removed"]) for r in substring_dedup.without_repeats(odd).collect())
    lengths = {x[2]: [y[3:] for y in got if y[2] == x[2] and y[0]] for x in got}
    assert [x[3:] for x in got if not x[0]] == [(0, 0), (60, 0)]  # the null id comes first and keeps its words
    assert all(a == b for v in lengths.values() for a, b in zip(v, v[1:], strict=False))  # repeated rows get equal results


# All of them on odd inputs

ALL = {
    "1": lambda d, s: token_counts.token_counts(d, BYTES, shared.scratch(s, "cache")), "2": lambda d, s: fingerprints.fingerprints(d), "3": lambda d, s: pii.pseudonyms(d, pii.DEMO_KEY), "4": lambda d, s: licenses.licenses(d),
    "5": lambda d, s: bpe_codec.encoded(d, WORDS), "6": lambda d, s: jaccard_join.similarity_classes(d), "6b": lambda d, s: jaccard_join.representatives(d), "7": lambda d, s: packing.packed(d, WORDS),
    "8": lambda d, s: sharding.sharded(d, [1.0] * 24), "9": lambda d, s: quality.quality(d), "9b": lambda d, s: quality.passing(d), "10": lambda d, s: substring_dedup.without_repeats(d),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, empty, name):
    assert ALL[name](empty, spark).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_odd_rows(spark, odd, name):
    out = ALL[name](odd, spark).collect()
    assert len(out) == {"6b": 4, "9b": 4}.get(name, 7)
    if name in ("1", "4", "8", "9", "5"):
        twice = Counter(tuple(v for k, v in r.asDict().items() if k != "slot") for r in out if r["doc_id"] == 7)
        assert max(twice.values()) == 2
