"""Packing, decontamination, scores, media, chat and URL filters against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, common, decontaminate, labelled, packing, ppm, quality, queries, tiff, toxicity, url_filter

from .conftest import COLUMNS, rows_of, words

# packing


def brute_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_cover_every_id(corpus, nothing):
    pieces = packing.pack(corpus, window=256).collect()
    by_row, offsets = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == offsets.get(p.sequence_id, 0) and len(p.ids) == 4 * p.length and 0 < p.length
        offsets[p.sequence_id] = p.offset + p.length
        by_row.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    assert sorted(offsets) == list(range(len(offsets))) and all(offsets[s] == 256 for s in range(len(offsets) - 1))
    found = Counter()
    for (doc, n), own in by_row.items():
        run, at = [], 0
        for p in own:  # in the order of sequences, a document's pieces follow each other
            if p.start == 0 and at:
                at, run = 0, []
            assert p.start == at
            at += p.length
            run += np.frombuffer(bytes(p.ids), "<u4").tolist()
            if at == n:
                found[doc, tuple(run)] += 1
                at, run = 0, []
        assert at == 0
    assert found == Counter((r.doc_id, tuple(brute_ids(r.text))) for r in corpus.collect())
    assert packing.pack(nothing).collect() == []


def test_sequences_and_digests(corpus):
    pieces = packing.pack(corpus, window=256)
    total = sum(len(brute_ids(r.text)) for r in corpus.collect())
    out = sorted(packing.sequences(pieces, 256).collect(), key=lambda r: r.sequence_id)
    assert sum(r.n_tokens for r in out) == total and all(len(r.ids) == 1024 for r in out[:-1])
    last = out[-1]
    assert len(last.ids) // 4 in {1 << k for k in range(9)} and len(last.ids) // 8 < last.n_tokens <= len(last.ids) // 4
    assert sorted(zlib.crc32(bytes(p.ids)) for p in pieces.collect()) == sorted(r.ids_crc32 for r in packing.digest(pieces).collect())


def test_words_encode_as_whole_texts():
    odd = ["a'b. it's. don't, x'. 's. é. á. ß!? Á, <|endoftext|>. a<|endoftext|>b Σας. ΣΑΣ. %%%. a%. 12.5. 3.. . x\x85y q\x1cq İ. 日本。 ﬁ. Ⅷ. ½. a̸. ≠. x　.", "", "  ", None, " lead ÀÉ ùÿ Œ. \x0b\x0c\x1f µ ª º"]
    ids, n = packing.WordEncoder(packing.default_vocabulary()).encode(pa.array(odd), 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [brute_ids(t) for t in odd] and n.tolist() == [len(brute_ids(t)) for t in odd]
    sliced, _ = packing.WordEncoder(packing.default_vocabulary()).encode(pa.array(["É " * 500, *odd] * 3)[2:], 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in sliced.to_pylist()] == [brute_ids(t) for t in (["É " * 500, *odd] * 3)[2:]]


def test_other_vocabularies_encode_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    config = json.load(open(packing.default_vocabulary(), encoding="utf-8"))
    assert packing.splits_words(config)
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(config | {"normalizer": None}), encoding="utf-8")
    joined = tmp_path / "joined.json"
    joined.write_text(json.dumps(config | {"added_tokens": [dict(config["added_tokens"][0], content="to be")]}), encoding="utf-8")
    odd = ["To be or NOT to be.", "", None, "a  b\tc it's", "É è"]
    for path in (public_tokenizers.path("byte_bpe_50k.json"), str(cased), str(joined)):
        ids, n = packing.WordEncoder(path).encode(pa.array(odd), 2)
        whole = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids + [2] for t in odd]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == whole and n.tolist() == list(map(len, whole))


# decontamination


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low + " ":
        if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def brute_hits(text, items, window):
    doc, hit, names = brute_words(text), set(), set()
    for name, item in items:
        ws = brute_words(item)
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if size else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == ws[k : k + size]:
                    hit |= set(range(j, j + size))
                    names.add(name)
    return len(doc), len(hit), names


@pytest.mark.parametrize("shard_bytes", [4_000_000, 300])
def test_contamination_equals_brute_force(spark, shard_bytes):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(4, 30)))) for k in range(12)] + [(90, "Only, three. words"), (91, ""), (92, None), (3, "a b"), (None, "zz")]
    docs = []
    for k in range(60):
        ws = [rng.choice(["a", "b", "c", "d", "é", "X9"]) for _ in range(rng.randint(0, 60))]
        if k % 4 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = (rng.choice(items[:12])[1]).upper().split()
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(ws)))
    docs += [(90, "so only three WORDS here"), (91, None), (92, ""), (93, "zz"), (None, "a-b")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if n is None else str(n), t) for n, t in items]
    expected = []
    for d, t in docs:
        n, hit, names = brute_hits(t, named, 7)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected.append((d, n, hit, len(names), sha, hit > 0 and 20 * hit >= n))
    found = decontaminate.contamination(df, bench, 7, shard_bytes)
    assert sorted(((r.doc_id, r.n_words, sum(r.hits[1::2]) - sum(r.hits[::2]), len(r.items)) for r in found.collect()), key=repr) == sorted((e[:4] for e in expected), key=repr)
    if shard_bytes > 1000:
        assert rows_of(decontaminate.report(df, bench, 7), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected, key=repr)


def test_shards_are_held_one_at_a_time(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, words(rng, 20)) for k in range(40)]
    docs = spark.createDataFrame([(k, words(rng, 30) + " " + items[k % 40][1] + " " + words(rng, 5)) for k in range(80)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    n, shards = decontaminate._shards(bench, 500)
    sizes = [sum(len(t) for _, t in s) for s in shards]
    assert n == len(sizes) > 5 and sum(sizes) == sum(len(t.encode()) for _, t in items) and max(sizes) < sum(sizes) / 3
    live, most = [], []
    plain = type(spark.sparkContext).broadcast

    def counted(context, value):
        found = plain(context, value)
        live.append(found)
        most.append(len(live))
        gone = found.destroy
        monkeypatch.setattr(found, "destroy", lambda: (live.remove(found), gone()), raising=False)
        return found

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    found = decontaminate.contamination(docs, bench, 13, 500).collect()
    assert len(most) == n and max(most) == 1 and not live
    monkeypatch.undo()
    assert sorted(found) == sorted(decontaminate.contamination(docs, bench, 13).collect()) and all(r.hits for r in found)


def test_passages_are_cut(spark, corpus, nothing):
    rng = random.Random(3)
    passage = words(rng, 15)
    docs = spark.createDataFrame([(1, f"Before it. {passage}! After, all of this text stays as it is, for it is longer than the passage itself by far, really.", 5), (2, passage, 9), (3, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert out.keys() == {1, 3} and out[1].text.startswith("Before it. ! After") and out[1].n_chars == len(out[1].text) and out[3].text is None
    assert decontaminate.decontaminate(nothing, bench).collect() == []
    none = bench.limit(0)
    assert decontaminate.decontaminate(corpus, none).count() == corpus.count() and decontaminate.report(corpus, none).where("n_hit > 0").count() == 0


# scores


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)] + [(None, "x"), (5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, 1), (6, None)], "doc_id long, toxic int")
    found = labelled.sample(docs, labels, "toxic", 3, 1, 80).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in found) and 80 <= len(found) <= 82 and {r.label for r in found} == {0, 1}


def labelled_corpus(spark, make, n=600):
    rng = random.Random(4)
    rows = [(k, *make(rng, k)) for k in range(n)]
    docs = [(k, t) for k, t, _ in rows] + [(n, None), (n + 1, ""), (None, "some words")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, label int")


def accuracy(found, labels, threshold):
    y = {r.doc_id: r.label for r in labels.collect()}
    held = [r for r in found.collect() if r.held_out and r.doc_id in y]
    assert len(held) > 50 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in held)
    return sum(r.predicted == y[r.doc_id] for r in held) / len(held)


def test_toxicity_learns_and_undoes_obfuscation(spark, nothing):
    insults = ["idiot", "moron", "loser"]

    def make(rng, k):
        bad = k % 4 == 0
        ws = words(rng, 60).split()
        if bad:
            ws.insert(rng.randint(0, 60), rng.choice(insults))
        return " ".join(ws), int(bad)

    docs, labels = labelled_corpus(spark, make)
    labels = labels.withColumnRenamed("label", "toxic")
    found = toxicity.classified(docs, labels)
    assert accuracy(found, labels.withColumnRenamed("toxic", "label"), 0.7) > 0.97
    model = toxicity.fit(docs, labels)
    for text in ("you 1d10t there", "an id1ot!", "m o r o n", "l-o-s-e-r there", "you idiooooot", "a m0r0n.", "1diot", "an id*ot", "i  d  i  o  t", "lloosseerr", '"moron"!', "1d107"):
        assert model.score(text) >= 0.7, text
    for text in ("", "the inner onering", "call 1-800-555 now", "a b c d e f", "on the reedan ******", "version 3.0.1 of it"):
        assert model.score(text) < 0.7, text
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns and 440 <= kept.count() <= 460
    empty = labels.limit(0)
    assert {r.score for r in toxicity.classified(docs, empty).collect()} == {0.0} and toxicity.classified(nothing, labels).collect() == []


def test_toxicity_learns_from_every_labelled_row(spark):
    """An insult of few rows, the last ones that a sample of 20,000 would take, and words beyond the commonest 50,000."""
    n, rare = 60_000, 40
    ids = spark.range(n).selectExpr("id as doc_id", "int(id % 2) as toxic")
    last = ids.where("toxic = 1 and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").orderBy(F.xxhash64("doc_id").desc()).limit(rare)
    chosen = {r.doc_id for r in last.collect()}
    name = lambda k: "w" + "".join(chr(97 + k // 26**i % 26) for i in range(4))
    rows = [(d, " ".join([*(name((d * 8 + j) % 52_000) for j in range(8)), "zorgblat" if d in chosen else "civil", "idiot" if d % 2 else ""])) for d in range(n)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist(), ids.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    seen = [(t, d % 2) for d, t in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    texts = Counter(w for t, _ in seen for w in set(t.split()))
    assert sum(k >= 3 for k in texts.values()) > 50_000
    assert model.cues["zorgblat$"] == pytest.approx(math.log(rare + 0.5) - math.log(0.5))
    assert model.cues["idiot$"] == pytest.approx(math.log(sum(y for _, y in seen) + 0.5) - math.log(0.5))
    assert model.chars.counts == toxicity.CharModel.of(Counter({w: k for w, k in texts.items() if k >= toxicity.LEAST_WORD})).counts
    # The curve is that of all rows at once, and the query's scores are the model's.
    x = np.array([toxicity.row(model.evidence(t)) for t, _ in seen])
    expected = quality.logistic(x, np.array([y for _, y in seen]), model.rate, ridge=0.1)
    assert model.weights == pytest.approx(expected.tolist(), rel=1e-6, abs=1e-6)
    few = rows[:50] + [(None, None), (7, "zorgblat")]
    scores = {(r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame(few, "doc_id long, text string"), model).collect()}
    assert scores == {(d, model.score(t or "")) for d, t in few}
    by_query = {r.doc_id: r.score for r in toxicity.classified(docs, labels).collect()}
    assert len(by_query) == n and all(by_query[d] == pytest.approx(model.score(t), abs=1e-9) for d, t in rows[:200])
    docs.unpersist()


def lattice(word, model):
    """Every reading of a word, with its cost."""
    out = []

    def step(k, context, last, cost, text):
        if k == len(word):
            out.append((cost + model.log(context, " "), text))
            return
        c = word[k]
        if c == last and last:
            step(k + 1, context, last, cost + toxicity.REPEATED, text)
        if c in toxicity.SEPARATORS:
            step(k + 1, context, "", cost + toxicity.DROPPED, text)
            if c == " " and context != "  ":
                step(k + 1, "  ", "", cost + toxicity.DROPPED + model.log(context, " "), text + " ")
            return
        for letter in toxicity.LOOKS.get(c, ""):
            step(k + 1, context[1] + letter, c, cost + toxicity.SUBSTITUTED + model.log(context, letter), text + letter)
        step(k + 1, context[1] + c, c, cost + (0.0 if c.isalpha() else toxicity.KEPT_SYMBOL) + model.log(context, c), text + c)

    step(0, "  ", "", 0.0, "")
    return out


def test_the_search_finds_the_likeliest_of_all_readings():
    rng = random.Random(12)
    model = toxicity.CharModel.of(Counter({w: rng.randint(1, 30) for w in words(rng, 300).split() + ["idiot", "moron", "bless", "sit", "it", "i"]}))
    for _ in range(400):
        word = "".join(rng.choice("1i0ot3s5$!b8-. l") for _ in range(rng.randint(1, 8)))
        readings = lattice(word, model)
        best = max(cost for cost, _ in readings)
        assert toxicity.restore_word(word, model) in {text for cost, text in readings if cost > best - 1e-9}, word
    long = "1d" + "1" * 5000 + "0t"
    assert toxicity.restore_word(long, model) == "idiot" and len(toxicity.restore_word("ab" * 50_000, model)) == 100_000


def test_masked_words_meet_every_cue_they_may_be():
    cues = {"idiot$": 3.0, "moro": 2.0, "fool$": 1.5, "oaf$": 1.0, "moron$": 2.5, "losers": 0.5}
    tree = toxicity.CueTree(cues)
    rng = random.Random(14)

    def brute(word):
        """All texts of a masked word, by letters in place of marks."""
        found = {("", "", 0)}
        best = 0.0
        alive = set("idotmrnflase")
        for c in word:
            following = set()
            for text, last, shown in found:
                if c == last and last:
                    following.add((text, last, shown))
                if c in toxicity.SEPARATORS:
                    following.add((text, "", shown))
                letters = (alive | {"?"} if text else set()) if c == "*" else set() if c in toxicity.SEPARATORS else {*toxicity.LOOKS.get(c, ""), c}
                for x in letters:
                    if shown >= 0:
                        best = max([best, *(v for cue, v in cues.items() if text == cue)])
                    following.add((text + x, "" if c == "*" else c, shown + (-1 if c == "*" else 1)))
            found = following
        return max([best, *(cues.get(text + "$", 0.0) for text, _, shown in found if shown >= 0)])

    for _ in range(300):
        word = "".join(rng.choice("i1d*o0tm*rnf1*") for _ in range(rng.randint(1, 6)))
        assert toxicity.masked_weight(word, tree) == brute(word), word
    assert toxicity.masked_weight("i**ot", tree) == 3.0 and toxicity.masked_weight("i****", tree) == 0.0 and toxicity.masked_weight("m0r*ns", tree) == 2.0
    assert toxicity.masked_weight("f" + "*" * 100_000, tree) == 0.0


def test_long_spaced_out_and_repeated_insults(spark):
    chars = toxicity.CharModel.of(Counter({"idiot": 5, "moron": 5, "the": 50, "inner": 20, "a": 40, "ring": 9}))
    model = toxicity.Model({"idiot$": 5.0, "moron$": 5.0}, (-2.0, 0.0, 1.0, 0.0, 0.0, 0.0), 0.1, chars)
    for text in ("a m o r o n", "m o r o n  i d i o t", "1d" + "1" * 70 + "0t", "mo" + "o" * 200 + "ron", "m." + "." * 90 + "oron", "x " * 20_000 + "id*ot"):
        assert model.score(text) > 0.7, text[:50]
    for text in ("", "the inner ring", "a " * 50_000, "*" * 5000, "1" * 5000, "a*b*c"):
        assert model.score(text) < 0.7, text[:50]


def test_quality_features_equal_a_plain_recomputation():
    import zstandard as z

    rng = random.Random(3)
    good, bad = (b" ".join(rng.choice(pool) for _ in range(4000)) for pool in ([b"the", b"inner", b"ring"], [b"%%", b"$$$", b"x9"]))
    model = quality.Model(quality._dictionary([good]), quality._dictionary([bad]), (0.1, 1.0, -0.5, 0.2, 0.3), 0.8)

    def size(data, dictionary=None):
        """The frame without what every frame has: magic number, descriptor and window."""
        given = {"dict_data": z.ZstdCompressionDict(dictionary)} if dictionary else {}
        return len(z.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, **given).compress(data))

    tools = model.compressors()
    for text in (b"the inner ring", good[:5000], bad[:5000], good[:3000] + bad[:3000], b"x" * 10_000, rng.randbytes(3000)):
        blocks = [text[k : k + 2048] for k in range(0, len(text), 2048)]
        with_good, with_bad = (sum(size(b, d) - 6 for b in blocks) / len(text) for d in (model.good, model.bad))
        whole = min(size(text) / len(text), 2.0)
        expected = [1.0, 10 * (with_bad - with_good), (with_good + with_bad) / 2, whole, 5 * (with_bad - with_good) * (with_good + with_bad)]
        assert quality.features(text, tools) == pytest.approx(expected)
        p = 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, expected))))
        assert model.scores([text, b""]) == [pytest.approx(p), 0.8]


def test_quality_learns(spark, nothing):
    def make(rng, k):
        text = words(rng, 80)
        bad = k % 5 == 0
        return (" ".join(w + rng.choice(["%%%", "&&&", "$$$"]) for w in text.split()) if bad else text), int(not bad)

    docs, labels = labelled_corpus(spark, make)
    labels = labels.withColumnRenamed("label", "quality")
    assert accuracy(quality.classified(docs, labels), labels.withColumnRenamed("quality", "label"), 0.3) > 0.97
    rate = {r.score for r in quality.classified(docs, labels).collect() if r.doc_id in (600, 601)}
    assert len(rate) == 1 and 0.7 < rate.pop() < 0.9
    assert {r.score for r in quality.classified(docs, labels.limit(0)).collect()} == {0.5} and quality.classified(nothing, labels).collect() == []


def brute_ppm(trained, text, order):
    """PPM with method C escapes and exclusion, straight from the counts."""
    counts = {}
    for t in trained:
        data = b"\0" * 5 + t + b"\0"
        for k in range(5, len(data)):
            for size in range(order + 1):
                counts.setdefault(data[k - size : k], Counter())[data[k]] += 1
    total, data = 0.0, b"\0" * 5 + text + b"\0"
    for k in range(5, len(data)):
        excluded, size = set(), order
        while True:
            seen = counts.get(data[k - size : k] if size else b"", Counter()) if size >= 0 else None
            if seen is None:
                total -= math.log10(256 - len(excluded))
                break
            open_ = {s: n for s, n in seen.items() if s not in excluded}
            n, q = sum(open_.values()), len(open_)
            if data[k] in open_:
                total += math.log10(open_[data[k]] / (n + q))
                break
            if q:
                total += math.log10(q / (n + q))
            excluded |= seen.keys()
            size -= 1
    return total


@pytest.mark.parametrize("order", [5, 2, 1])
def test_ppm_equals_brute_force(corpus, order):
    rows = corpus.where("length(text) < 900 or text is null").collect()
    df = corpus.where("length(text) < 900 or text is null")
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    trained = [r.text or "" for r in rows if not held(r.doc_id)]
    framed = [b"\0" * 5 + t.encode() + b"\0" for t in trained]
    max_strings = len({d[k - order : k + 1] for d in framed for k in range(5, len(d))})  # those of the next length are more
    c = Counter(w for t in trained for w in low(t))
    c[None] = len(trained)
    n, v = sum(c.values()), len(c)
    expected = {}
    for r in rows:
        ws = [*low(r.text), None]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        expected.setdefault((r.doc_id, r.text), (held(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n, base, brute_ppm([t.encode() for t in trained], (r.text or "").encode(), order)))
    found = ppm.held_out_scores(df) if order == 5 else ppm.scored(df, ppm.crc_mod("doc_id", 7) != 2, max_strings).selectExpr("doc_id", "not trained as held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = sorted(([*r] for r in found.collect()), key=repr)
    want = sorted(([r.doc_id, *expected[r.doc_id, r.text]] for r in rows), key=repr)
    assert len(got) == len(want)
    key = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_ppm_keeps_its_order_at_every_size():
    from inspect import signature

    assert signature(ppm.scored).parameters["max_strings"].default is None
    rng = np.random.default_rng(8)
    docs = [bytes(rng.integers(97, 100, 300, np.uint8)) for _ in range(20)]
    keys, n = ppm.string_counts(docs[:15])
    pairs = ppm._summed(keys & np.uint64(0xFFFF), n)
    known = {b: ppm._unpacked(data) for b, _, data in ppm._bucketed(keys, n)}
    asked, zero = ppm.string_counts(docs)
    found = []
    for b, _, data in ppm._bucketed(asked, zero):  # each bucket by itself
        strings = ppm._unpacked(data)[0]
        trie = ppm.Trie.of(*known.get(b, (keys[:0], n[:0])), pairs)
        assert b not in known or len(trie.levels) == ppm.ORDER + 1
        found += zip(strings.tolist(), trie.costs(strings).tolist())
    strings, costs = map(np.array, zip(*sorted(found)))
    for d, s in zip(docs, ppm.scores(docs, strings.astype(np.uint64), costs)):
        assert s == pytest.approx(brute_ppm(docs[:15], d, ppm.ORDER), rel=1e-6)


def test_ppm_without_training_or_rows(spark, nothing):
    from pyspark.sql import functions as F

    assert ppm.held_out_scores(nothing).collect() == []
    (r,) = ppm.scored(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0) and r.score == pytest.approx(-3 * math.log10(256)) and r.base_score == 0.0


# media


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trips(compression, predictor):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (5, 7, 1)), np.full((40, 64, 1), 65), rng.integers(0, 3, (33, 20, 3)), np.arange(64 * 200).reshape(200, 64, 1) % 251, rng.integers(0, 256, (1, 1, 1))]
    images = [i.astype(np.uint8) for i in images]
    for order in "<>":
        for layout in ({"rows": 8}, {"rows": 1000}, {"tile": 16}):
            data = tiff.encode(images, compression, predictor, order=order, **layout)
            found = list(tiff.pages(data))
            assert [p.index for p in found] == list(range(5)) and all((p.pixels == i).all() for p, i in zip(found, images))


def test_codecs():
    rng = random.Random(6)
    for _ in range(60):
        data = bytes(rng.choice(b"abc\0") for _ in range(rng.randint(0, 400))) * rng.choice([1, 1, 30])
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.unpack_bits(tiff.pack_bits(data)) == data
    noise = rng.randbytes(30_000)
    assert tiff.lzw_decode(tiff.lzw_encode(noise)) == noise and tiff.unpack_bits(tiff.pack_bits(noise)) == noise
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    coded = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(coded) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == coded


def brute_feature(payload):
    rows = [payload[k : k + 64] for k in range(0, len(payload), 64)]
    n, mean = len(payload), sum(payload) / len(payload)
    spread = math.sqrt(max(0.0, sum(b * b for b in payload) / n - mean * mean))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
    down, across = (sorted({k * size // 8 for k in range(8)}) for size in (len(rows), 64))
    cells = [sum(sum(r[x0:x1]) for r in rows[y0:y1]) for y0, y1 in zip(down, [*down[1:], len(rows)]) for x0, x1 in zip(across, [*across[1:], 64])]
    bits = "".join("1" if c * len(cells) > sum(cells) else "0" for c in cells)
    return f"{len(rows)}x64 mean={mean:.3f} std={spread:.3f} entropy={abs(entropy):.3f} grid={int(bits.ljust(-(-len(bits) // 8) * 8, '0'), 2).to_bytes(-(-len(bits) // 8), 'big').hex()}"


@pytest.mark.parametrize("compression", list(tiff.ENCODERS))
def test_tiff_pages_that_are_too_large_are_refused(compression):
    """A header that declares far more than its strips hold must not take memory."""
    import struct

    data = bytearray(tiff.encode([np.zeros((2, 64, 1), np.uint8)], compression))
    at = struct.unpack_from("<I", data, 4)[0]
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag = struct.unpack_from("<H", data, at + 2 + 12 * k)[0]
        if tag in (256, 257, 278):
            struct.pack_into("<I", data, at + 10 + 12 * k, 1 << 31)
    with pytest.raises(ValueError):
        list(tiff.pages(bytes(data)))


def test_media_table(spark, corpus, nothing):
    files = tiff.stored(corpus, page_rows=16)
    out = {(r.doc_id, r.payload_sha256): r for r in tiff.digest(files).collect()}
    for r in corpus.collect():
        data = (r.text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        d = out[r.doc_id, hashlib.sha256(payload).hexdigest()]
        assert (d.n_bytes, d.payload_bytes, d.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:])) and d.feature
    pages = tiff.decode_pages(files, "doc_id", "media").collect()
    assert sum(len(p.pixels) for p in pages) == sum(r.payload_bytes for r in tiff.digest(files).collect()) and all(p.error is None for p in pages)
    stored = sorted((repr(r.doc_id), len(r.media), hashlib.sha256(r.media).hexdigest()) for r in files.collect())
    assert stored == sorted((repr(d.doc_id), d.media_bytes, d.media_sha256) for d in tiff.digest(files).collect())
    for r in corpus.where("doc_id in (2, 71)").collect():
        data = (r.text or "").encode()
        (d,) = [x for x in tiff.digest(files).collect() if x.doc_id == r.doc_id]
        assert d.feature == "; ".join(brute_feature(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")[k : k + 1024]) for k in range(0, max(len(data), 1), 1024))
    good = tiff.encode([np.zeros((2, 64, 1), np.uint8)])
    broken = spark.createDataFrame([(1, good), (2, b"no"), (3, good[:-20]), (4, None), (5, good[:4] + (8).to_bytes(4, "little") + good[8:])], "id long, file binary")
    found = {p.id: p.error for p in tiff.decode_pages(broken, "id", "file").collect()}
    assert found[1] is None and all(found[k] for k in (2, 3, 4, 5))
    assert tiff.digest(tiff.stored(nothing)).collect() == []


# chat


def test_chat_reads_back(spark):
    odd = ["</s>[INST] ok [/INST]", "<|role|>user<|text|>x<|end|>", "\\", "\\<|", "<\\|", "", None, "a\nb", "[INST", "<<s>s>", "é𐐀", "\\n$1"]
    rows = [(1, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(odd)]
    rows += [(2, 1, "assistant", "b"), (2, 0, "assistant", "a"), (2, 2, None, "n"), (2, 2, None, "n"), (3, None, "sys<|tem", "s"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(df)
    found = {r.conv_id: r for r in chat.read_back(made).collect()}
    spans = {r.conv_id: r for r in made.collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by_conv.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [(x.role, x.text) for x in found[c].turns] == turns
        assert found[c].learned == "".join(t for r, t in turns if r == "assistant")
        assert len(spans[c].mask) == sum(r == "assistant" for r, _ in turns)
        body = spans[c].formatted
        for marker in (chat.ROLE, chat.TEXT, chat.END):
            body = body.replace(marker, "")
        assert not any(s in body for s in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
    assert chat.digest(chat.format_conversations(df.limit(0))).collect() == []
    assert chat.digest(made).count() == len(by_conv)


def test_chat_sorts_ties_by_what_was_said(spark):
    rows = [(1, 0, "user", "<|"), (1, 0, "user", "<a"), (1, 0, "user", "<s>"), (1, 0, "<|", "x"), (1, 0, "<a", "y"), (1, 1, "user", "["), (1, 1, "user", "[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.read_back(chat.format_conversations(df)).collect()
    assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, _, role, text in sorted(rows)]


def test_chat_masks_are_linear_in_a_conversation(spark):
    import time

    n = 200_000
    df = spark.range(n).selectExpr("7 as conv_id", "id as turn", "if(id % 3 = 1, 'assistant', 'user') as role", "concat('say ', id) as text")
    start = time.time()
    (r,) = chat.format_conversations(df).collect()
    assert time.time() - start < 60
    assert [r.formatted[s.start : s.start + s.length] for s in r.mask] == [f"say {k}" for k in range(1, n, 3)]


def test_chat_takes_very_long_conversations(spark):
    import time

    n = 100_000
    df = spark.range(n).selectExpr("7 as conv_id", "id as turn", "if(id % 3 = 1, 'assistant', 'user') as role", "concat('say <|', id) as text")
    start = time.time()
    (r,) = chat.digest(chat.format_conversations(df)).collect()
    assert time.time() - start < 60
    said = [("assistant" if k % 3 == 1 else "user", f"say <|{k}") for k in range(n)]
    learned = "".join(t for who, t in said if who == "assistant")
    assert (r.n_turns, r.turns_sha256) == (n, hashlib.sha256("".join(f"{who}\n{t}\n" for who, t in said).encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    one = spark.createDataFrame([(1, 0, "assistant", "x" * 5_000_000)], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(one)).first().loss_chars == 5_000_000


# URL filters


def test_url_rules_as_of_their_time(spark):
    e = lambda kind, key, verdict, action, day: (kind, key, verdict, action, f"2024-01-{day:02d}")
    entries = [
        e("domain", "bad.org", "block", "add", 5), e("domain", "bad.org", "block", "remove", 10), e("domain", "bad.org", "block", "add", 20), e("domain", "bad.org", "block", "add", 22),
        e("host", "ok.bad.org", "allow", "add", 1), e("prefix", "mixed.com/x", "block", "add", 1), e("url", "mixed.com/x/fine?a=1", "allow", "add", 1), e("host", "WWW.Caps.net", "block", "add", 1),
        e("domain", "tie.io", "block", "add", 1), e("domain", "tie.io", "allow", "add", 1), e("host", "both.io", "block", "add", 3), e("host", "both.io", "block", "remove", 3),
        e("nokind", "ok.com", "block", "add", 1), e("host", None, "block", "add", 1), ("host", "ok.com", "block", "add", None), e("host", "ok.com", "block", "remove", 1),
    ]
    cases = [
        ("http://bad.org/a", 4, "allow"), ("http://bad.org/a", 5, "block"), ("https://sub.bad.org:8080/a", 9, "block"), ("http://bad.org", 10, "allow"), ("http://bad.org", 21, "block"),
        ("http://notbad.org", 6, "allow"), ("http://u@ok.bad.org/", 6, "allow"), ("http://mixed.com/x", 2, "block"), ("http://mixed.com/x/y?q#f", 2, "block"), ("http://mixed.com/xy", 2, "allow"),
        ("http://mixed.com/x/fine?a=1#top", 2, "allow"), ("http://caps.net./", 2, "block"), ("http://tie.io/", 2, "allow"), ("http://both.io/", 3, "block"), ("http://ok.com", 2, "allow"),
        ("mailto:x", 2, "allow"), (None, 2, "allow"), ("http://bad.org", None, "allow"), ("", 6, "allow"),
    ]
    rows = [(k, u, d and f"2024-01-{d:02d}", "x", "y") for k, (u, d, _) in enumerate(cases)] * 2
    captures = spark.createDataFrame(rows, "id int, url string, fetched_at string, url_verdict string, kind string")
    listed = spark.createDataFrame(entries, "kind string, key string, verdict string, action string, effective_at string")
    found = url_filter.evaluate(captures, listed).collect()
    assert len(found) == 2 * len(cases)
    for r in found:
        assert r.url_verdict == cases[r.id][2], cases[r.id]
    kept = url_filter.keep_allowed(captures, listed)
    assert kept.columns == captures.columns and kept.count() == 2 * sum(c[2] == "allow" for c in cases)
    assert url_filter.evaluate(captures.limit(0), listed).collect() == [] and url_filter.evaluate(captures, listed.limit(0)).where("url_verdict = 'block'").count() == 0


def test_the_native_operator_runs_no_python(spark, sf_dir, capsys):
    for name in ("op1_url_filter", "op3_chat_format"):
        queries.queries()[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


# queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, expected = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    columns = sorted(df.columns)
    pick = lambda names, data: sorted(([str(r[names.index(c)]) for c in columns] for r in data), key=repr)
    assert pick(df.columns, df.collect()) == pick(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", [q for q in queries.queries() if q not in queries.oracle_sql()])
def test_queries_have_a_row_per_document(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    df = queries.queries()[name](spark, sf_dir)
    assert df.select("doc_id").distinct().count() == n


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        before, docs = docs.count(), corpus_pipeline.written(out, "test")
        assert before >= docs.count() > 0.5 * before, name
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_url_filter_takes_directory_prefixes(spark):
    rules = [("prefix", k, "block", "add", "2024-01-01") for k in ("a.com/ads/", "b.com/x/y/", "c.com/")]
    listed = spark.createDataFrame(rules, "kind string, key string, verdict string, action string, effective_at string")
    urls = ["http://a.com/ads/1", "http://a.com/ads", "http://a.com/adsense", "http://b.com/x/y/z?q", "http://b.com/x", "http://c.com/"]
    captures = spark.createDataFrame([(u, "2024-02-01") for u in urls], "url string, fetched_at string")
    assert [(r.url, r.url_verdict) for r in url_filter.evaluate(captures, listed).orderBy("url").collect()] == [(u, "allow" if u in ("http://a.com/adsense", "http://b.com/x") else "block") for u in sorted(urls)]


def test_url_filter_takes_very_long_urls(spark):
    import time

    steps = "/".join(["s"] * 100_000)
    urls = [f"http://long.com/{steps}/end?q=1", "http://" + "a." * 100_000 + "bad.org/x", "http://long.com/s/s/t"]
    rules = [("prefix", "long.com/s/s/s", "block"), ("prefix", "long.com/s/s/t", "block"), ("domain", "bad.org", "block"), ("url", f"long.com/{steps}/end?q=1", "allow"), ("prefix", "long.com", "block")]
    listed = spark.createDataFrame([(*r, "add", "2024-01-01") for r in rules], "kind string, key string, verdict string, action string, effective_at string")
    captures = spark.createDataFrame([(k, u, "2024-02-01") for k, u in enumerate(urls)], "id int, url string, fetched_at string")
    start = time.time()
    found = {r.id: (r.url_verdict, r.url_rule_kind) for r in url_filter.evaluate(captures, listed).collect()}
    assert time.time() - start < 30
    assert found == {0: ("allow", "url"), 1: ("block", "domain"), 2: ("block", "prefix")}


# shared


def test_clashing_columns_are_kept_or_ignored(spark, corpus):
    """Extra columns that have the names of an operator's own."""
    odd = "doc_id", "text", *(f"{k} as {n}" for k, n in enumerate(("row", "n", "ids", "part", "at", "block", "trained", "key", "media", "hits", "items", "n_words", "d", "h", "score", "held_out", "label", "own_hash", "node", "size", "features", "page")))
    plain, odd = corpus.where("doc_id < 20").select("doc_id", "text"), corpus.where("doc_id < 20").selectExpr(*odd)
    labels = plain.selectExpr("doc_id", "int(doc_id % 2) as toxic", "int(doc_id % 2) as quality", "1 as text", "2 as label")
    bench = plain.limit(2).selectExpr("doc_id as item_id", "substring(text, 1, 300) as text", "1 as name", "2 as shard")
    for run in (
        lambda d: packing.digest(packing.pack(d)),
        lambda d: toxicity.classified(d, labels),
        lambda d: quality.classified(d, labels),
        lambda d: decontaminate.report(d, bench),
        lambda d: ppm.held_out_scores(d),
        lambda d: tiff.digest(tiff.stored(d)),
    ):
        a, b = run(plain), run(odd)
        assert a.columns == b.columns and a.count() == b.count()
    assert toxicity.keep_civil(odd, labels).columns == odd.columns
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns and decontaminate.decontaminate(odd, bench).count() <= odd.count()
    rows = spark.createDataFrame([(1, 0, "user", "x", 5, 6, 7)], "conv_id long, turn long, role string, text string, turns int, formatted int, parts int")
    assert chat.format_conversations(rows).columns == ["conv_id", "formatted", "mask"]
    listed = spark.createDataFrame([("host", "a.com", "block", "add", "2024-01-01", 1, 2)], "kind string, key string, verdict string, action string, effective_at string, at int, host int")
    captures = spark.createDataFrame([("http://a.com/", "2024-02-01", 1, 2, 3, 4)], "url string, fetched_at string, u int, t int, row int, best int")
    (r,) = url_filter.evaluate(captures, listed).collect()
    assert (r.u, r.t, r.row, r.best, r.url_verdict) == (1, 2, 3, 4, "block")


def test_settings_of_the_session_are_kept(spark):
    key, tidy = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, str(64 << 20))
        common.session(spark)
        common.written(spark.range(10), "settings")
        assert spark.conf.get(key) == str(64 << 20) and spark.conf.get(tidy) == "false"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
