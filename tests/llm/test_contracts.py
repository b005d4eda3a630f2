"""Operators against brute force, on awkward rows."""

import random
import re
import tempfile
import time

import public_tokenizers
import pytest
import tokenizers
import xxhash

from tests.llm import brute
from timbrewatch.llm import bpe, decontaminate, fingerprints, licenses, lines, pii, quality, secrets, simhash, warc
from pyspark.sql import functions as F

LONG = "word " * 3000 + "AKIA" + "Q" * 20 + " 4111 1111 1111 1111 a@b.example"
ROWS = [
    (1, None), (2, ""), (3, " \t "), (4, "The MIT License and the Apache License\nshared line of text"), (5, "SHARED LINE of text \nÉtat ŁÓDŹ 'll go"),
    (6, "token = \"abcdefgh12345678\" 10.0.0.255 10.0.0.256 x.y@z.example.com +1 (555) 555-1234"), (7, LONG), (8, LONG), (9, LONG + " tail"),
    (10, "token=secret :abcdefghijk " + "0123456789abcdef" * 4), (11, "a@b.c._x@y.z 1 2 3 4 " + "4" * 60), (12, "gnu general public license cc by"),
    (13, "😀 two 𝒳 signs <|endoftext|> ΣΑΣ é"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string")


def same(df, want, *cols):
    key = df.columns[0]
    assert {r[key]: tuple(r[c] for c in cols) for r in df.collect()} == want


def test_licenses(docs):
    same(licenses.scan_licenses(docs), brute.op1(ROWS), "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_notices_are_verified_in_order(spark):
    """Edited notices are found; their grams in reverse order or far apart are not. All labels and scores as in brute force."""
    r = random.Random(2)
    rows = []
    for notice in licenses.NOTICES:
        w = notice.split()
        grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
        rows += [" ".join(w), " xx ".join([notice] * 3), " ".join(w[:5] + ["new"] + w[5:]), " ".join(w[:6] + w[7:]), " ".join(reversed(grams)),
                 " far off it is ".join(grams), " ".join(r.sample(grams, len(grams))), " ".join(w[:len(w) // 2])]
        rows += [" ".join(x for x in w if r.random() < 0.9) + " of the " + " ".join(r.choices(w, k=30)) for _ in range(6)]
    rows += ["", None, "of the of the " * 500]
    docs = [(k, t) for k, t in enumerate(rows)]
    base = brute.op1(docs)
    want = {}
    for k, t in docs:
        labels, score = brute.op1_notices(t)
        mine = {x for x in base[k][4].split(",") if x}
        want[k] = (",".join(sorted(labels | mine)), round(1.0 if mine else score, 9))
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, pos int")
    got = {x.doc_id: (x.labels, round(x.score, 9)) for x in licenses.scan_licenses(df).collect()}
    assert got == want
    assert all(got[14 * k + j][0] for k in range(len(licenses.NOTICES)) for j in range(4))
    assert not any(got[14 * k + j][0] != base[14 * k + j][4] for k in range(len(licenses.NOTICES)) for j in (4, 5))


def test_license_places_of_one_id_stay_apart(spark):
    rows = [(1, "gnu general x"), (1, "q general public license"), (None, "mit license"), (None, "mit"), (2, "cc by"), (2, "cc by")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_base, r.labels) for r in got) == [("1", 0, ""), ("1", 0, ""), ("2", 1, "cc-by"), ("None", 0, ""), ("None", 1, "mit")]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h


def winnowed(text):
    """(leading 34 bits decide, all 64 are kept), by position."""
    words = [w[i:i + 16] for w in re.findall(r"\S+", text, re.A) for i in range(0, len(w), 16)]
    kept = brute.winnow(words, fingerprints.K, fingerprints.WINDOW, lambda g: chained(g) >> 30)
    return list(dict.fromkeys(chained(words[at:at + fingerprints.K]) for _, at in sorted(kept, key=lambda x: x[1])))


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def check_fingerprints(spark, rows, bucket_rows):
    """All columns, for any spread of ids; the order of rows that share an id is read from the result."""
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, k string")
    got = fingerprints.fingerprint_edits(df, bucket_rows).collect()
    signed = lambda t: chained([t]) >> 1
    docs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]), reverse=True)
    spelt = lambda f: " ".join(f"{h:x}" for h in f)
    want = []
    for j, (i, t) in enumerate(docs):
        after = docs[(j + 1) % len(docs)][1]
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        f, e, g = winnowed(t), winnowed(edited), winnowed(after)
        want.append((i, len(t), brute.sha(edited), spelt(f), spelt(e), round(alike(f, e), 9), round(alike(f, g), 9)))
    mine = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(mine, key=lambda r: str(r)) == sorted(want, key=lambda r: str(r))


@pytest.mark.parametrize("bucket_rows", [1024, 3])
def test_fingerprints(spark, bucket_rows):
    check_fingerprints(spark, ROWS, bucket_rows)


def test_fingerprints_of_any_ids(spark):
    words = [f"w{j % 7} w{j % 11} w{j % 3} w{j} w{j % 5}" for j in range(300)]
    edges = [-(1 << 63), (1 << 63) - 1, -9 * 10**18, 9 * 10**18, 5, 10**12]
    check_fingerprints(spark, list(zip(edges, words)), 1)
    check_fingerprints(spark, [(j, w) for j, w in enumerate(words[:200])] + [(10**12, "far off")], 10)
    repeated = [(7 if j % 3 else j, w) for j, w in enumerate(words)] + [(None, w) for w in words[:100]] + [(8, "same text")] * 5
    check_fingerprints(spark, repeated, 10)
    check_fingerprints(spark, [(None, None)], 10)
    check_fingerprints(spark, [], 10)


def test_buckets_are_small_for_any_ids(spark):
    """Clustered ids with one far off, and an id and null that hold a third of the rows each."""
    ids = [(j, f"t{j}") for j in range(900)] + [(1 << 60, "x")] + [(5, f"r{j}") for j in range(900)] + [(None, f"n{j}") for j in range(900)]
    df = spark.createDataFrame(ids, "doc_id long, text string")
    sizes = fingerprints.with_next(df, 30).groupBy("bucket", "lead").count().agg(F.max("count")).first()[0]
    assert sizes <= 120


def test_secrets(docs):
    same(secrets.scan_secrets(docs), brute.op4(ROWS), "n_assign", "n_access", "n_hex", "base_sha256")


def test_lines(docs):
    out = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept"))
    same(out, brute.op5(ROWS), "n_lines", "n_dropped", "kept")


def test_pii(docs):
    same(pii.find_pii(docs), brute.op7(ROWS), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_codec(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    same(bpe.encode_digests(docs, path, 10), brute.op8(ROWS, path), "n_tokens", "ids_sha256", "decoded_sha256")


def test_simhash(docs):
    out = simhash.near_duplicates(docs, 4, 4).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    same(out, brute.op9(ROWS), "f", "component_id")


def test_archives(spark):
    pages = [(i, t) for i, t in ROWS]
    df = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i} a", t) for i, t in pages], "page_id long, url string, html string")
    same(warc.archive_pages(df), brute.op10(pages), "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_contamination(spark):
    item = "In May the farm of Anna sold 12 km of rope and then 12 boxes of nails to Berta for use"
    other = item.replace("12", "77")
    mixed = item.replace("12 km", "77 km")
    docs = spark.createDataFrame([(1, "so it was. " + item + " and more"), (2, other), (3, mixed), (4, None), (5, "clean text of no interest at all to any")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None)], "item_id long, text string")
    found = {r.doc_id: r["items"] for r in decontaminate.mark_contaminated(docs, bench).collect()}
    assert found == {1: [9], 2: [9], 3: [], 4: [], 5: []}


def test_top_k(spark):
    keys = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 4, 3, 2, 9]], "key double")
    assert quality.top_k_cut(keys, 3)[0] == 4.0 and quality.top_k_cut(keys, 0) is None


def test_quality_of_long_texts(spark):
    """Joined good texts stay, at any length; junk and toxic texts go at any length."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    bad = lambda n: " ".join(f"w{r.randrange(400)} |" if r.random() < 0.8 else "menu" for _ in range(n))
    toxic = lambda n: " ".join("idiot" if r.random() < 0.03 else r.choice(words) for _ in range(n)) + " idiot"
    rows = [(i, (prose, prose, prose, bad, toxic)[i % 5](r.randrange(60, 200)), int(i % 5 != 3), int(i % 5 == 4)) for i in range(600)]
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int")
    good = [t for _, t, q, x in rows if q and not x]
    long = [(1000 + i, " ".join(r.sample(good, n))) for i, n in enumerate([1, 10, 30, 100] * 5)]
    long += [(2000 + i, make(n)) for i, n in enumerate([100, 1000, 10000]) for make in (bad, toxic)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + long, "doc_id long, text string")
    models, seen = quality.fit_models(docs, labels)
    scores = {(x.doc_id, x.log_weight >= models.cut) for x in quality.score_documents(docs, models).filter("doc_id >= 1000").collect()}
    assert scores == {(i, i < 2000) for i, _ in long}
    left = quality.rejections_by_length(docs, labels).collect()
    assert sum(x.n for x in left) == seen.filter("fold = 4").count() > 0
    assert sum(x.rejected for x in left if x.good) <= 0.1 * sum(x.n for x in left if x.good)


@pytest.mark.parametrize("k", [None, 40])
def test_quality_scores_and_selection_equal_brute_force(spark, k):
    r = random.Random(11)
    word = lambda: r.choice(["alpha", "beta", "Gamma", "été", "x9", "ΔΣ", "menu", "idiot"] + [f"w{i}" for i in range(60)])
    rows = [(i, " ".join(word() + (" |" if i % 4 == 0 else ".") for _ in range(r.randrange(3, 80)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "no id"), (402, "w1 w2"), (402, "w3"), (402, "w3"), (403, "w5 | " * 4000), *rows[:5]]
    labels = [(i, int(i % 4 != 0), int("idiot" in t)) for i, t in rows[:260]] + [(400, 1, 0), (None, 0, 1), (3, 0, None)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, key string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.resample(docs, rated, k).collect()
    want, cut = brute.op3(rows, labels)
    limit = k or sum(w >= cut for w, *_ in want.values())
    kth = sorted((key for _, key, _ in want.values()), reverse=True)[limit - 1]
    spelled = lambda i, n, w, key, on: (str(i), n, round(w, 5), round(key, 4), on)
    assert sorted(spelled(x.doc_id, x.copies, x.log_weight, x.key, x.selected) for x in got) == sorted(
        spelled(i, n, w, key, key >= kth) for (i, _), (w, key, n) in want.items())


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (2, None)], "doc_id long, text string")
    got = {x.doc_id: (x.selected, x.copies) for x in quality.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: (True, 1), 2: (True, 2)}


def _items(spark, docs, bench):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {r.doc_id: r["items"] for r in decontaminate.mark_contaminated(docs, bench).collect()}


PASSAGE = ("The old mill by the river was built by farmers who sold 12 sacks of flour each week until the flood took its wheel away and left "
           "only stones behind. The town then paid 12 workers to raise another wheel from oak")


def test_contamination_with_one_changed_slot(spark):
    docs = [PASSAGE, PASSAGE.replace("12 sacks", "13 sacks"), PASSAGE.replace("The town", "Zorq town"), PASSAGE.replace("12", "77")]
    assert _items(spark, docs, [PASSAGE]) == {i: [0] for i in range(4)}


def test_contamination_counts_places_once(spark):
    phrase = "the flood took its wheel away and left"
    fill = [" ".join(f"{a}{b}" for b in ("zu", "ka", "mo", "ti")) for a in ("ba", "co", "du", "fe", "gi", "ho", "ju", "ly")]
    often = " ".join(f"{x} {phrase}" for x in fill)
    inserted = PASSAGE.replace("sold", "often sold").replace("until", "just until").replace("raise", "soon raise")
    scattered = " ".join(f"{' '.join(fill)} {' '.join(PASSAGE.split()[i:i + 8])} {' '.join(fill)}" for i in range(0, 31, 5))
    assert _items(spark, [often, inserted, scattered], [PASSAGE]) == {0: [], 1: [0], 2: []}


def test_contamination_by_numbers(spark):
    bench = ["Compute 12 + 7 + 45 + 3 + 18 + 22 + 91 + 4 + 60 + 5", "Sort the list 8 3 19 42 7 11 65 2 90 31 5 77 into ascending order"]
    docs = [f"so it says: {bench[0]} and on", f"task. {bench[1]}", "Compute 13 + 8 + 46 + 4 + 19 + 23 + 92 + 5 + 61 + 6", "12 of 45 men"]
    assert _items(spark, docs, bench) == {0: [0], 1: [1], 2: [], 3: []}


def test_secret_owners(spark):
    line = lambda k: f"token = {k}Abcdefgh12345678"
    rows = [(1, line("a"), "s0"), (2, line("a"), "s1"), (3, line("a"), "s2")]  # one text, copied whole
    rows += [(10 + i, f"{i} {line('b')}", "hot") for i in range(150)]  # pasted all over one owner
    rows += [(200 + i, f"{i} {line('c')}", f"s{i}") for i in range(5)]  # pasted by many owners
    rows += [(300 + i, f"{i} {line('d')}", f"s{i}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_live, r.n_example) for r in secrets.scan_secrets(docs).collect()}
    assert got == {i: (0, 1) if 10 <= i < 300 else (1, 0) for i, *_ in rows}


def test_pii_without_lead_words(spark):
    forms = ["so it is 123-45-6789 then", "please call me at 555 123 4567 today", "write to jane (at) example.com now", "pay to ES9121000418450200051332 soon"]
    wrong = ["so it is 000-00-0000 then", "pay to ES0000000418450200051332 soon"]
    rows = [(100 * i + j, t) for i, t in enumerate(forms + wrong) for j in range(100)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_more").collect()
    assert {(r.doc_id // 100, r.n_more) for r in got} == {(i, int(i < 4)) for i in range(6)}


def iban(body, right):
    """GB number with right or wrong check digits."""
    rest = int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
    return f"GB{(98 - rest + (0 if right else 7)) % 97:02d}{body}"


def test_pii_is_decided_span_by_span(spark):
    """In one mix of alike spans those that hold are redacted, whatever company they keep. Held out: no span is labelled by hand."""
    r = random.Random(9)
    body = lambda: "NWBK" + "".join(r.choices("123456789", k=14)) + "22"
    numbers = [iban(body(), k < 80) for k in range(200)]
    possible = [f"{r.randrange(100, 665)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}" for _ in range(120)]
    impossible = [f"000-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}" for _ in range(80)]
    rows = [(k, f"so take {n} then") for k, n in enumerate(numbers)] + [(1000 + k, f"so take {n} then") for k, n in enumerate(possible + impossible)]
    rows += [(5000, None), (5001, ""), (None, f"so take {numbers[0]} then"), (None, f"so take {numbers[0]} then")]
    r.shuffle(rows)
    got = pii.find_pii(spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, base string")).collect()
    assert len(got) == len(rows)
    found = {x.doc_id for x in got if x.spans}
    wrong = {x.doc_id for x in got if x.n_more} - {None, *range(80), *range(1000, 1120)}
    assert found >= {None, *range(80)} and not wrong
    assert len(found & set(range(1000, 1120))) >= 100


def test_contamination_equals_brute_force(spark):
    r = random.Random(11)
    words = ("mill river farmer sack flour week flood wheel stone town worker oak train leaves at meets Anna Berta Rome Oslo sold bought km kg hours 12 7 45 3 18").split()
    items = [(k, " ".join(r.choices(words, k=r.choice([3, 6, 9, 14, 25])))) for k in range(25)] + [(90, None), (91, "")]

    def changed(text):
        swap = {w: r.choice(words) for w in ("12", "7", "45", "Anna", "Rome", "km")}
        out = [swap.get(w, w) if r.random() < 0.8 else w for w in text.split()]
        if r.random() < 0.4:
            out.insert(r.randrange(len(out) + 1), r.choice(words))
        return " ".join(out)

    docs = [(k, " ".join(r.choices(words, k=20)) + " " + changed(items[k % 25][1]) + " " + " ".join(r.choices(words, k=10))) for k in range(75)]
    docs += [(200, None), (201, ""), (202, " ".join(t for _, t in items if t))]
    docs_df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, h string, pos int")
    got = {x.doc_id: x["items"] for x in decontaminate.mark_contaminated(docs_df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute.op6(docs, items)
    assert got == want and sum(map(bool, want.values())) > 30


def test_contamination_of_long_items_is_quick(spark):
    """An item of 2,000 tokens with all its numbers replaced; thousands of items of one template."""
    r = random.Random(12)
    text = " ".join(f"{r.randrange(1000)}" if k % 5 == 0 else f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for k in range(2000))
    again = " ".join(str(int(w) + 5000) if w.isdigit() else w for w in text.split())
    began = time.time()
    assert _items(spark, [again], [text]) == {0: [0]}
    assert time.time() - began < 60
    sums = [f"what is the sum of {a} and {a + 7} in the ring" for a in range(2000)]
    assert len(_items(spark, [sums[5], "nothing of the kind is said"], sums)[0]) >= 1


def test_codec_looks_up_few_pairs():
    """A merge looks only at the pairs it makes, and a state of the lexicon is read from its file once."""
    class Counted(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    path = public_tokenizers.path("word_bpe_49k.json")
    merger, reference = bpe.Merger(path), tokenizers.Tokenizer.from_file(path)
    words = ["", "a", "internationalisierung", "ñcidoèñ", "x" * 60, "ab" * 40, "straßenbahnhaltestelle", "zz9".replace("9", "ü") * 30]
    words += ["".join(random.Random(k).choices("aeinrstü", k=1 + k % 64)) for k in range(200)]
    ranks = merger.ranks = Counted(merger.ranks)
    for word in words:
        ranks.n = 0
        assert merger.encode(word) == (reference.encode(word, add_special_tokens=False).ids if word else [])
        assert ranks.n <= 3 * len(word.encode())
    with tempfile.NamedTemporaryFile() as f:
        f.write(bpe.compile_lexicon({w.encode(): merger.encode(w) for w in words[1:100]}))
        f.flush()
        lexicon = bpe.Lexicon(f.name)
    look = lambda: [lexicon.find(w.encode()) for w in words]
    first = look()
    lexicon.arcs = None
    assert look() == first and first[1:100] == [merger.encode(w) for w in words[1:100]] and None in first[100:]
