"""Corpus operators against brute force, round trips and held-out rows, with null, empty and repeated rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, embedding_dedup, language_id, mixing, ngram_join, pii, quality, substring_dedup, token_files, transport_stream

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocabulary = ["w%d" % i for i in range(300)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (120, 60, 45, 300)]
    out = [None, "", " \t", "one two", "ONE two", "a b c d e", "a b c d e f"]
    for b in base:
        w = b.split()
        out += [b, b.upper(), b]
        for k in range(12):
            edited = list(w)
            for _ in range(rnd.randrange(1, 8)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            out.append(" ".join(edited))
        out.append("intro %d " % len(out) + " ".join(w[3:48]) + " outro")
    out += ["same same " * 60, "x" * 50_000, "é" * 10 + "   zwei"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "src%d" % (i % 3), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, token string")


def components(links, ids):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_ngram_join(docs, texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = components(links, range(len(sets)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()}
    assert found == {i: (len(s), expected[i]) for i, s in enumerate(sets)}
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(expected.values()))


def test_ngram_join_long_words(spark):
    words = ["v%d" % i for i in range(20)]
    rows = [(k, " ".join([*words, w, *words[::-1]])) for k, w in enumerate(thue_morse())]
    found = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(0, 37, 0), (1, 37, 1)}


def test_ngram_join_empty(spark):
    assert ngram_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def thue_morse():
    """Two words of 1,024 letters whose polynomials modulo 2^64 agree for any odd base."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return w, w.translate(str.maketrans("ab", "ba"))


def kept_words(texts, window=35):
    rows = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[k : k + window]) for w in rows for k in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(docs, texts, batches):
    expected = dict(enumerate(kept_words(texts)))
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, batches=batches).collect()}
    assert found == expected


def test_substring_dedup_odd_rows(spark):
    x, y = thue_morse()
    words = ["v%d" % i for i in range(20)]
    texts = [" ".join([*words, w, *words[::-1]]) for w in (x, y)]
    rnd = random.Random(8)
    line = " ".join("l%d" % i for i in range(9))
    common = [" ".join([*("c%d" % rnd.randrange(99) for _ in range(15)), line, *("c%d" % rnd.randrange(99) for _ in range(15))]) for _ in range(40)]
    tail = " ".join("t%d" % i for i in range(40))
    rows = [(1, texts[0]), (2, texts[1]), *((10 + i, t) for i, t in enumerate(common)), (60, common[0] + " " + tail), (61, "z " + tail), (70, tail + " a"), (70, "b " + tail), (None, "n " + tail), (None, None), (71, "")]
    expected = collections.Counter((i, *k) for (i, _), k in zip(rows, kept_words([t for _, t in rows])))
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS check", "3 AS spans")
    assert collections.Counter(map(tuple, substring_dedup.remove_repeats(d).collect())) == expected
    assert substring_dedup.remove_repeats(d.where("false")).count() == 0


def test_incremental_index(spark, tmp_path):
    rnd = random.Random(1)
    path = str(tmp_path / "index")
    passages = [" ".join("p%d" % rnd.randrange(999) for _ in range(60)) for _ in range(3)]
    texts = {k: f"{'s%d ' % k * (k % 3)}{passages[k % 3]} {' '.join('q%d_%d' % (k, i) for i in range(50))}" for k in range(8)}
    docs = substring_dedup.keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    found = {}
    for k in range(8):  # each batch through an index that was opened anew
        index = substring_dedup.FingerprintIndex(spark, path)
        repeats, doubtful = index.add(docs.where(f"doc_id = {k}"))
        for r in [*repeats.collect(), *index.verify(doubtful, docs.where(f"doc_id <= {k}")).collect()]:
            found.setdefault(r.row, set()).update(w for s in range(r["first"], r["last"] + 1) for w in range(s, s + 35))
        assert len(index.runs) <= 4
        expected = kept_words([texts[j] for j in range(k + 1)])
        assert [len(found.get(j, ())) for j in range(k + 1)] == [e[1] for e in expected]
        index.close()


@pytest.mark.parametrize("stop", [1, 3, 4, 6])
def test_fingerprint_index_survives_a_stop(spark, tmp_path, monkeypatch, stop):
    """A job that is stopped at a change of the index's files, the third batch being added, goes on where the manifest stands."""
    rnd = random.Random(6)
    passage = ["p%d" % i for i in range(60)]
    some = lambda n: ["w%d" % rnd.randrange(10**6) for _ in range(n)]
    texts = {0: " ".join(some(50)), 1: " ".join(some(20) + passage), 2: " ".join(some(40)), 3: " ".join(passage + some(10)), 4: " ".join(some(45))}
    docs = substring_dedup.keyed(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    path, found = f"{tmp_path}/index", {}
    opened = lambda: substring_dedup.FingerprintIndex(spark, path)
    for k in range(5):
        index = opened()
        if k == 2:
            steps = [0]

            def counted(name, f):
                def run(*args, **names):
                    steps[0] += 1
                    if steps[0] == stop + 1:
                        raise OSError("stopped")
                    return f(*args, **names)

                return run

            with monkeypatch.context() as m:
                for name in ("_write", "_commit", "_remove"):
                    m.setattr(index, name, counted(name, getattr(index, name)))
                try:
                    results = index.add(docs.where("doc_id = 2"), "batch 2")
                except OSError:
                    results = None
            assert (results is None) == (stop < steps[0])
            index.close()
            index = opened()
            results = index.add(docs.where("doc_id = 2"), "batch 2")
        else:
            results = index.add(docs.where(f"doc_id = {k}"), f"batch {k}")
        for r in [*results[0].collect(), *index.verify(results[1], docs.where(f"doc_id <= {k}")).collect()]:
            found.setdefault(r.row, set()).update(w for s in range(r["first"], r["last"] + 1) for w in range(s, s + 35))
        expected = kept_words([texts[j] for j in range(k + 1)])
        assert [len(found.get(j, ())) for j in range(k + 1)] == [e[1] for e in expected]
        index.close()
    assert len([f for f in (tmp_path / "index").iterdir() if f.name.startswith(("run-", "batch-", "making-"))]) == len(opened().runs)


def test_mixing(docs, texts):
    rows = mixing.mixture(docs).collect()
    size = {i: len(words_of(t)) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / w for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in names:
        assert abs(targets[s] - target[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= max(size.values())
    again = {(r.doc_id, r.taken) for r in mixing.mixture(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}
    mixed = mixing.take_mixture(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_bpe(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    spec = bpe.word_tokenizer()
    rows = bpe.decode(bpe.encode(docs, spec), spec).collect()
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert [r.token_ids for r in bpe.as_array(bpe.encode(docs.where("doc_id = 3"), spec)).collect()][0] == library.encode("one two").ids


def test_bpe_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.WordBpe(bpe.word_tokenizer())
    rnd = random.Random(3)
    odd = ["a<|endoftext|>b <|startoftext|>", "ΣΑΣ İI'm we'll 123 ½", "\x1ca\x1d c\x85d", "aaaa" * 200, "é ﬁ"] + ["".join(rnd.choice("ab e'sS .,!1²éßΣσİ\n\t \x1c中🙂́") for _ in range(rnd.randrange(40))) for _ in range(500)]
    for text, ids in zip(odd, own.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_pieces_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    library, own = Tokenizer.from_str(spec), token_files.Pieces(spec)
    rnd = random.Random(4)
    letters = [*"abZé  ßñ\n\n.,!?:*#&'<>|_-012½²Ⅷ\t\r\xa0\u2003中á́🙂\x00\x1c\x85“—", "\ua7cb", "<|endoftext|>", "'s", "'ll", "the", "&&&"]
    odd = ["", "\n", " ", "one.\nTwo,\n\nthree", "Été.\nà***", "a\n b", "x²y.z"] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(15))) for _ in range(5_000)]
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_pieces_meet_distinct_parts_once(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    seen = []

    class Counted(token_files.Pieces):
        def get(self, part, *other):
            seen.append(part)
            return super().get(part, *other)

    library, own = Tokenizer.from_str(spec), Counted(spec)
    texts = ["", "an apple, an apple. An apple!", "a\n  b\0 c é", "\n", "", "an apple, Été\nan apple"] * 50
    found = own.lists(texts, (2).to_bytes(4, "little"))
    assert found.to_pylist() == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(seen) == len(set(seen)) < 20
    monkeypatch.setattr(token_files, "MEMORY", 3)
    for t in [*texts[:6], *texts[:6], "another apple, or two"]:
        assert own.lists([t]).to_pylist() == [library.encode(t, add_special_tokens=False).ids]
    assert own.lists([]).to_pylist() == own.encode([]) == []


def test_words_are_looked_up_without_their_points():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    seen = []

    class Counted(token_files.Pieces):
        def get(self, part, *other):
            seen.append(part)
            return super().get(part, *other)

    library, own = Tokenizer.from_str(spec), Counted(spec)
    texts = [f'Früh {w}{p} ({w}{p}\n{w}{p}"' for w in ("apple", "été", "слово") for p in (".", ",", ";", ":", "!", "?", "...", "")]
    found = own.lists(pa.array([None, *texts, None, ""]).slice(1), (2).to_bytes(4, "little"))
    assert found.to_pylist() == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, "", ""]]
    # With a blank before and without; points are parts of their own.
    assert len(seen) == len(set(seen)) and sum("apple" in p for p in seen) == sum("été" in p for p in seen) == sum("слово" in p for p in seen) == 2


def test_parts_end_where_the_library_ends_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    library, own = Tokenizer.from_str(spec), token_files.Pieces(spec)
    # Each character of two and three bytes beside points, blanks and line feeds.
    chars = [chr(c) for c in (*range(0x800), *range(0x1670, 0x1690), *range(0x2000, 0x2070), *range(0x2FF8, 0x3048))]
    texts = [t for c in chars for t in (f"a{c}.{c}b", f"{c} {c}", f".{c}\n{c},", f"\n{c}  {c}\n\n{c}", f"{c}<|endoftext|>{c}")]
    rnd = random.Random(8)
    texts += ["".join(rnd.choice([*"ab é×÷ßя\n\n.,(\"'|<>1\u2028\u2003\u3000\x1c\xa0\x85”", "<|endoftext|>", "'s"]) for _ in range(rnd.randrange(20))) for _ in range(5_000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark, docs, texts, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, spec)
    at = 0
    found = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_transport_stream(docs, texts):
    rows = transport_stream.read(transport_stream.store(docs)).collect()
    for r in rows:
        n, payload = transport_stream.padded(texts[r.doc_id])
        assert r.n_bytes == n and bytes(r.stream.payload) == payload and r.stream.errors == 0
        assert r.stream.stamps[0].random_access and r.stream.stamps[0].pts == 0
    broken = bytearray(transport_stream.mux(b"x" * 57_600))
    broken[188 * 5 + 3] ^= 3
    assert transport_stream.demux(bytes(broken))["errors"] > 0


def test_transport_stream_repeated_packet():
    payload = bytes(range(256)) * 9 * 8
    packets = [m[i : i + 188] for m in [transport_stream.mux(payload)] for i in range(0, len(m), 188)]
    twice = b"".join([*packets[:6], packets[5], *packets[6:]])
    assert transport_stream.demux(twice)["payload"] == payload and transport_stream.demux(twice)["errors"] == 0


def test_pii_base():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rnd = random.Random(9)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "b@", "@", ".", "1", "2", "9", " ", "-", "+", "(", "x.y", "é", "192.168.1.1", "4111111111111111"]) for _ in range(rnd.randrange(25)))
        expected = []
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                d = "".join(c for c in m[0] if c in "0123456789")
                fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                if fits:
                    expected.append((kind, *m.span()))
        assert pii.base_spans(t) == expected


def test_pii_bootstrap(spark):
    rows = [(i, f"please call +4930123456{i:02d} today") for i in range(20)] + [(90, "please call 030 998 877 66 today"), (91, "the year 1999 was 12345678 long"), (92, None), (93, "")]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 24 and [s.kind for s in found[3].spans] == ["phone"]
    assert not found[90].base and not found[91].spans and not found[92].spans
    masked = pii.mask(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in masked.collect()}[3] == "please call [PHONE] today"


def test_pii_unseen_shapes(spark):
    rows = [(i, f"please call +4930123456{i:02d} today") for i in range(20)] + [(90, "please call 030 998 877 66 today"), (91, "the year 1999 was 12345678 long"), (92, "badge 4711 0815 77 issued")]
    national = [f"0{i}0 554 43{i}" for i in range(2, 6)]
    rows += [(20 + i, f"please call {n} today or ask under {n} anytime") for i, n in enumerate(national)]
    rows += [(93, "ask under 0771 23 45 67 anytime")]
    rows += [(30 + i, f"number {n} noted") for i, n in enumerate(["+49301234501", "+49301234502", "+49301234503", *(f"{k}00 200 {k}" for k in range(10, 40))])]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not found[90].base and [tuple(s) for s in found[90].spans] == [("phone", 12, 26)]
    assert all(len(found[20 + i].spans) == 2 for i in range(4))
    assert [s.kind for s in found[93].spans] == ["phone"], "only accepted strings share its patterns"
    assert not any(found[i].spans for i in (91, 92, *range(33, 63)))


def test_pii_text_ends(spark):
    rows = [(i, f"{['please call', ''][i % 2]} +49 30 1234 56{i:02d} {['', 'answers'][i % 2]}".strip()) for i in range(40)]
    rows += [(90, "please call +0 30 1234 90123456789011"), (91, "+0 30 1234 90123456789012 answers"), (92, "+0 30 1234 90123456789013")]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(found[i].base for i in (90, 91, 92))
    assert [tuple(s) for s in found[90].spans] == [("phone", 12, 37)]
    assert [tuple(s) for s in found[91].spans] == [("phone", 0, 25)]
    assert not found[92].spans


def test_pii_long_strings(spark):
    long = "k" * 90
    rows = [(i, f"{long} mail me at user{i}@example.org {long} ok") for i in range(20)]
    rows += [(90, f"mail me at {'ü' * 80}@intern {long}"), (91, "x" * 50_000 + "@"), (92, "7" * 5000)]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[90].spans] == [("email", 11, 98)]
    assert not found[91].spans and not found[92].spans


def brute_language(train, texts):
    """The word-first backoff in plain Python."""
    words, grams = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang in train:
        for w in language_id.words_of(text):
            words[lang][w] += 1
            for n in range(1, 5):
                t = w if n == 1 else f"<{w}>"
                grams[lang].update(t[i : i + n] for i in range(len(t) - n + 1))
    langs = sorted(words)
    known, pieces = set().union(*words.values()), set().union(*grams.values())
    totals = {(x, n): sum(c for g, c in grams[x].items() if len(g) == n) for x in langs for n in range(1, 5)}

    def word(w):
        if w in known:
            return [np.log((words[x][w] + 0.5) / (sum(words[x].values()) + 0.5)) for x in langs]
        for n in (4, 3, 2, 1):
            t = w if n == 1 else f"<{w}>"
            found = [g for i in range(len(t) - n + 1) if (g := t[i : i + n]) in pieces]
            if found:
                return [np.mean([np.log((grams[x][g] + 0.5) / (totals[x, n] + 1.0)) for g in found]) for x in langs]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        scores = np.sum([word(w) for w in language_id.words_of(t)] or [[0.0] * len(langs)], axis=0)
        out.append((langs[int(scores.argmax())], 1 / np.exp(scores - scores.max()).sum()) if language_id.words_of(t) else ("und", 0.0))
    return out


def test_language_id_brute_force(spark):
    rnd = random.Random(4)
    make = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(n))
    rows = [(k, make("abcdeé" if k % 2 else "cdefgß", 12), "xx" if k % 2 else "yy") for k in range(30)]
    rows += [(40, None, "xx"), (41, "text", None), (None, "nobody", "xx"), (5, rows[5][1], "xx")]
    texts = [make("abcdefgßé", 9) for _ in range(20)] + ["² ½ Ⅷ", "", None, "a", "zzz 中文"]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS lang_pred", "2 AS unit")
    model = language_id.train(d)
    expected = brute_language([r[1:] for r in rows if None not in r], texts)
    found = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    for k, (lang, score) in enumerate(expected):
        assert found[k].lang_pred == lang and abs(found[k].score - score) < 1e-9 and found[k].unit == 2
    smaller = language_id.train(d, most=3)
    assert len(smaller["words"]) < len(model["words"])


def test_queries(spark, tmp_path, texts):
    """Every registered query over one small corpus, its digests by brute force."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from ledgerloom.llm import queries

    rows = [(i, t, ("de", "en")[i % 2] if i % 7 else None, None if i % 5 == 0 else "src%d" % (i % 3), i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    vectors = [(i, [float((i * 7 + k * k) % 11) for k in range(4)], i % 2) for i in range(40)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = {}
    for f in queries.QUERIES:
        df = f(spark, str(tmp_path))
        found[f.__name__.split("_")[0]] = [{r[0]: r for r in df.collect()}, df.columns]
    plain = [t or "" for t in texts]
    crc = [zlib.crc32(str(i).encode()) for i in range(len(texts))]
    words, tokens = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    kept, start = kept_words(texts), 0
    for i, t in enumerate(plain):
        raw = t.encode()
        assert found["op1"][0][i].held_out == (crc[i] % 5 == 0) and found["op8"][0][i].held_out == (crc[i] % 4 == 2)
        assert found["op8"][0][i].predicted == (found["op8"][0][i].score >= 0.7)
        base = pii.base_spans(t)
        assert tuple(found["op3"][0][i])[:6] == (i, *(sum(s[0] == k for s in base) for k in pii.KINDS), sha(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()))
        ids = words.encode(t, add_special_tokens=False).ids
        assert tuple(found["op4"][0][i]) == (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(words.decode(ids, skip_special_tokens=False).encode()))
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = transport_stream.mux(payload)
        assert tuple(found["op6"][0][i])[:7] == (i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media))
        assert tuple(found["op7"][0][i]) == (i, *kept[i][:2], sha(kept[i][2].encode()))
        ids = np.array([*tokens.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert tuple(found["op10"][0][i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert [found[f"op{n}"][1][:5] for n in (1, 2, 5, 9)] == [["doc_id", "held_out", "lang_pred", "score"], ["doc_id", "size", "source_size", "target", "taken"], ["doc_id", "n_shingles", "component_id"], ["vec_id", "n_links", "component_id", "kept"]]
    u = np.array([v[1] for v in vectors])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.arange(40)[:, None] % 2 == np.arange(40) % 2) & ~np.eye(40, dtype=bool)
    assert all(found["op9"][0][i].n_links == linked[i].sum() for i in range(40))


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_queries_of_empty_tables(spark, tmp_path, name):
    from ledgerloom.llm import queries

    for t, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<double>, label int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    (query,) = (f for f in queries.QUERIES if f.__name__.startswith(name + "_"))
    assert query(spark, str(tmp_path)).count() == 0


def test_language_id(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(d.where(language_id.fold("doc_id", 5) != 0))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 .")], "doc_id long, text string")
    rows = language_id.predict(d.select("doc_id", "text").unionByName(extra), model).join(d.select("doc_id", "lang"), "doc_id", "left").collect()
    held = [r for r in rows if r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id < 0)
    assert language_id.train(d.where("false"))["langs"] == []


def test_quality_risk(spark):
    """The weights leave no slope of the risk, and the prior is that of a mixture of known parts."""
    rnd = random.Random(6)
    good = lambda: " ".join(rnd.choice(["the", "house", "stands", "near", "a", "river", "and", "mill"]) for _ in range(40)) + "."
    bad = lambda: " ".join("#!%x" % rnd.randrange(1 << 20) for _ in range(40))
    rows = [(i, good() if i % 10 < 6 else bad()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500) if i % 10 < 6 and i % 3], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert abs(model.prior - 0.6) < 0.05
    x = model.design(np.array([quality.features(t) for _, t in rows]), quality.hashed([t.encode() for _, t in rows])).astype(float)
    g, p = x @ model.weights, np.array([i % 10 < 6 and i % 3 > 0 for i in range(1500)])
    slope = (1 / (1 + np.exp(-g))) @ x / 1500 - model.prior * x[p].mean(axis=0) + quality.PRECISION / 1500 * model.weights
    negative = np.logaddexp(0, g).mean() - model.prior * np.logaddexp(0, g[p]).mean()
    assert negative >= -1e-6 and (np.abs(slope).max() < 5e-3 or negative < 0.2)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all(abs(scores[i] - 1 / (1 + np.exp(-min(30, max(-30, g[i]))))) < 1e-4 for i in range(1500))
    assert min(scores[i] for i in range(1500) if i % 10 < 6) > max(scores[i] for i in range(1500) if i % 10 >= 6)


def test_quality(spark, sf_dir):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(d.where(quality.fold("doc_id", 4) != 2), labels.where(quality.fold("doc_id", 4) != 2))
    rows = quality.score(d, model).join(labels, "doc_id").where(quality.fold("doc_id", 4) == 2).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    empty = quality.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), model).collect()
    assert all(0 <= r.score <= 1 for r in empty)


def test_embeddings(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(12, 16))
    v = centre[rnd.integers(0, 12, 300)] + rnd.normal(scale=0.12, size=(300, 16))
    rows = [(i, [float(x) for x in v[i % 280]], i % 2) for i in range(300)]
    odd = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[0][1], None), (304, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine, label = u @ u.T, np.array([r[2] for r in rows])
    linked = (cosine >= 0.93) & (label[:, None] == label[None]) & ~np.eye(300, dtype=bool)
    expected = components([(int(a), int(b)) for a, b in zip(*np.nonzero(linked))], range(305))
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(df, shard_rows=64).collect()}
    assert len(found) == 305
    recall = sum(found[i].n_links for i in range(300)) / linked.sum()
    assert 0.9 <= recall <= 1
    assert all(found[i].n_links <= linked[i].sum() for i in range(300))
    assert sum(found[i].component_id == expected[i] for i in range(305)) >= 0.95 * 305
    assert all(found[i].n_links == 0 and found[i].kept for i in range(300, 305))


def test_bpe_of_letters_that_unicode_added():
    """Code points that our tables don't know are split as the library splits them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    new = [*range(0x10D40, 0x10D90), *range(0x1C89, 0x1C8B), *range(0xA7CB, 0xA7DD), *range(0x105C0, 0x105F4), *range(0x11380, 0x113E3), *range(0x13460, 0x13600), *range(0x16D40, 0x16D7A), *range(0x1E5D0, 0x1E5FB), 0x0378, 0xE0080, 0x10FFFF]
    texts = [t for c in map(chr, new) for t in (f"a{c}b {c}{c} 1{c}", f"É{c}{c.upper()}.")]
    expected = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.WordBpe(spec).encode(texts) == expected


def test_embeddings_with_few_links(spark):
    """Two shards of some 3,000 vectors with 60 links among them: audits of real links see next to none."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((6000, 32))
    for a, b in rng.permutation(6000)[:120].reshape(60, 2):
        v[a] = v[b] + 0.2 * rng.standard_normal(32)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & ~np.eye(6000, dtype=bool)
    expected = components([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)], range(6000))
    df = spark.createDataFrame([(i, [float(x) for x in r], 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert linked.sum() > 80 and found == {i: (int(linked[i].sum()), expected[i]) for i in range(6000)}


def test_planted_links():
    x = embedding_dedup._unit(np.random.default_rng(7).standard_normal((500, 8)))
    nodes, queries = embedding_dedup.plant(x, 0.93)
    assert len(nodes) == 256 and np.allclose((x[nodes] * queries).sum(axis=1), 0.93, atol=1e-5) and np.allclose(np.linalg.norm(queries, axis=1), 1, atol=1e-5)
    assert len(embedding_dedup.plant(x[:1], 0.93)[0]) == 1 and len(embedding_dedup.plant(np.ones((3, 1), np.float32), 0.93)[0]) == 0


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = docs.withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, rows, "")
        assert out.columns == rows.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[4][1](spark, rows, "").where("n_tokens <> size(token_ids)").count() == 0


def test_pipeline_run(spark, tmp_path):
    """run() against a plain version: rejects, classes, masks, copies and ids."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(12)
    words = {"de": ["haus", "und", "nicht", "wald", "fluss", "mühle"], "en": ["house", "and", "not", "forest", "river", "mill"]}
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(i, say("de" if i % 2 else "en", 20 + i), "de" if i % 2 else "en", "s%d" % (i % 3)) for i in range(24)]
    rows += [(30, rows[3][1], "de", "s0"), (31, rows[4][1].upper(), None, "s1"), (32, "12 34 ½", "en", "s1"), (33, None, "en", "s2"), (34, "", None, None)]
    rows += [(35, say("en", 30) + " write to anna@example.org or 192.168.0.1", None, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {i: (text, lang, source) for i, text, lang, source in rows if i not in (32, 33, 34)}
    kept[35] = (kept[35][0], "en", "s2")
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, (t, _, _) in kept.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = {i: kept[i] for i, c in components(links, sets).items() if i == c}
    assert 30 not in kept and 31 not in kept
    kept[35] = (kept[35][0].replace("anna@example.org", "[EMAIL]").replace("192.168.0.1", "[IP]"), "en", "s2")
    staged = spark.createDataFrame([(i, *r) for i, r in kept.items()], "doc_id long, text string, lang string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mixture(staged).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = collections.Counter({(i, lang, source, tuple(library.encode(t, add_special_tokens=False).ids)): copies[i] for i, (t, lang, source) in kept.items() if copies[i]})
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.lang, r.source, tuple(r.token_ids)) for r in found) == expected
    assert all(r.n_tokens == len(r.token_ids) for r in found)


def plain_tilts(cells, targets):
    """Tilts by bisection in numpy: of each source (sizes, counts), the rates min(3, exp(tilt * size / mean)) whose words meet the target."""
    out = {}
    for key, (sizes, counts) in cells.items():
        sizes, counts = np.array(sizes, float), np.array(counts, float)
        x = sizes / ((sizes * counts).sum() / counts.sum())
        lo, hi = -1e7, 1e7
        for _ in range(300):
            mid = (lo + hi) / 2
            over = (sizes * counts * np.minimum(3, np.exp(np.minimum(mid * x, 10)))).sum() > targets[key]
            lo, hi = (lo, mid) if over else (mid, hi)
        out[key] = lo
    return out


@pytest.mark.parametrize("rows", [[("a", "one"), ("b", "two")], [("a", "one")], [("a", "one"), ("b", "two"), (None, "three four")], [("a", "w " * 7), ("b", "w"), ("c", "w " * 3), ("d", "w " * 11), ("e", "")], [("a", "w")] * 7 + [("b", "w " * 13)] * 3])
def test_mixing_settles_on_small_tables(spark, rows):
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = mixing.mixture(df).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    for r in found:
        assert r.taken <= 3 * r.size
    by = collections.defaultdict(list)
    for r in found:
        by[rows[r.doc_id][0]].append(r)
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part)


def test_tilts_equal_a_plain_search(spark):
    rnd = random.Random(8)
    cells = {f"={s}": (sorted(rnd.sample(range(1, 900), 40)), [rnd.randrange(1, 50) for _ in range(40)]) for s in "abc"} | {"": ([1], [1]), "=d": ([3, 1], [1, 2])}
    sizes = {k: sum(a * b for a, b in zip(*v, strict=True)) for k, v in cells.items()}
    targets = {"=a": 2.4 * sizes["=a"], "=b": 0.2 * sizes["=b"], "=c": 1.0 * sizes["=c"], "": 1 / 3, "=d": 10 / 3}
    c = spark.createDataFrame([(k, a, b) for k, v in cells.items() for a, b in zip(*v, strict=True)], "key string, size long, n long")
    t = spark.createDataFrame([(k, sizes[k], targets[k]) for k in cells], "key string, source_size long, target double")
    found = {r.key: r.tilt for r in mixing.tilts(c, t).collect()}
    assert found == {k: pytest.approx(v, abs=2e-7) for k, v in plain_tilts(cells, targets).items()}
