"""Token files, tokenizer alignment and collocations against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelweave.llm import alignment, collocations, queries, segments, sequences

ODD = [
    None, "", " ", "\n\t", "a", "a", "end.\n\nThe  end , (really)!", "<|endoftext|> <|STARTOFTEXT|>x <0x41>", "naïve ÀÉ ﬁ ½ K Å İ ẞ",
    "日本語 テスト。", "é ́x ạ́b", "don't 'tis O'Neil's.", "x▁y ▁ z", "b c\x1cd\x85e f", "😀😀 <=> 12,345.67%", "ab" * 400,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"wo{i}rd" for i in range(80)] + ["Über", "naïve", "日本", "end.", "(x)", "a,b"]
    texts = ODD + [" ".join(rng.choices(words, k=rng.choice([1, 3, 30, 200]))) for _ in range(60)]
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    ids[3], ids[20], ids[21] = None, None, ids[22]
    rows = [(i, t, "x" if i else None, "y") for i, t in zip(ids, texts, strict=True)]
    rows += [rows[0], rows[30], rows[30]]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, mask string").repartition(5), rows


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Token files


def word_ids(text):
    return words_apart().tokenizer.encode(text or "", add_special_tokens=False).ids + [queries.END_ID]


def test_token_files(spark, docs):
    df, rows = docs
    manifest = sequences.write_sequences(df, queries.WORD_VOCABULARY, queries.END_ID, length=16)
    read = sorted(rows_of(sequences.read_documents(manifest)), key=lambda r: r[1])
    assert Counter((i, tuple(ids)) for i, _, _, ids in read) == Counter((i, tuple(word_ids(t))) for i, t, *_ in rows)
    order = [i for i, *_ in read]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))
    total = 0
    for _, start, n, ids in read:
        assert (start, n) == (total, len(ids))
        total += n
    # The sequences hold the same ids in the same order, apart from what the masks hide.
    flat = [ids for file in sequences.sequence_files(spark, manifest) for i in range(len(file)) for ids in [(file[i])]]
    assert all(len(ids) == 16 and len(mask) == 16 for ids, mask in flat)
    assert np.concatenate([ids[mask.to_numpy(zero_copy_only=False)] for ids, mask in flat]).tolist() == [t for r in read for t in r[3]]
    sums = {(i, s): c for i, s, _, c in rows_of(sequences.read_checksums(manifest))}
    assert sums == {(i, s): zlib.crc32(np.array(ids, "<u4").tobytes()) for i, s, _, ids in read}


def test_random_access_is_a_view(spark, docs):
    df, _ = docs
    manifest = sequences.write_sequences(df, queries.WORD_VOCABULARY, queries.END_ID, length=8)
    file = next(sequences.sequence_files(spark, manifest))
    ids, mask = file[1]
    assert not ids.flags.owndata and not ids.flags.writeable
    assert ids.__array_interface__["data"][0] - file[0][0].__array_interface__["data"][0] == 8 * ids.itemsize
    assert isinstance(mask, pa.BooleanArray) and mask.offset == 8


def test_unlisted_files_do_not_count(spark, docs, tmp_path):
    """What a lost attempt of a task left in the folder is not read."""
    df, rows = docs
    folder = f"file://{tmp_path}/tokens"
    sequences.write_sequences(df, queries.WORD_VOCABULARY, queries.END_ID, folder)
    manifest = sequences.write_sequences(df, queries.WORD_VOCABULARY, queries.END_ID, folder)
    assert sequences.read_documents(manifest).count() == len(rows)


@lru_cache(maxsize=1)
def words_apart():
    return sequences.word_encoder(segments.read_text(queries.WORD_VOCABULARY), 4)


@given(st.text(st.sampled_from("abzAÉéßşΣσς'sltd.,!<|>endoftx \n\t́ 12½日K"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_apart(text):
    found = np.frombuffer(b"".join(words_apart().ids(text)), "<u4").tolist()
    assert found == words_apart().tokenizer.encode(text, add_special_tokens=False).ids


def test_long_text_in_slices():
    text = " ".join(f"w{i}, é{i % 7}" for i in range(3000))
    parts = list(segments.slices(text, re.compile(" "), 100))
    assert "".join(parts) == text and len(parts) > 50


def test_cache_forgets():
    encoder = sequences.WordIds(segments.read_text(queries.WORD_VOCABULARY), 4, limit=3000)
    for i in range(60):
        text = f"Again x{i}, again."
        assert np.frombuffer(b"".join(encoder.ids(text)), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder) + len(encoder.older) < 50


# Alignment


def brute_alignment(rows):
    byte_level = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    byte_level.encode_special_tokens = True
    piece_level = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    texts, counts = [], Counter()
    for doc_id, text in rows:
        a = byte_level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece_level.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in byte_level.id_to_token(i)) for i in a]
        names = [(i, piece_level.id_to_piece(i)) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if piece_level.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]
        groups = []
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends = [dict(zip(np.cumsum([len(x) for x in side]).tolist(), range(1, len(side) + 1), strict=True)) for side in (bytes_a, bytes_b)]
            before = (0, 0)
            for end in sorted(set(ends[0]) & set(ends[1])):
                now = ends[0][end], ends[1][end]
                groups.append((a[before[0] : now[0]], b[before[1] : now[1]]))
                before = now
        texts.append((doc_id, groups))
        counts.update({(x, y) for g, h in groups for x in g for y in h})
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    for doc_id, groups in texts:
        links = [(x, y) for g, h in groups for x in g for y in h]
        written = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield (
            doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
            sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("hot_pairs", [1 << 19, 50])
def test_alignment(docs, hot_pairs):
    """With 50 broadcast pairs the links of all others go through the shuffle."""
    df, rows = docs
    found = rows_of(alignment.link_scores(df, queries.BYTE_VOCABULARY, queries.PIECE_MODEL, hot_pairs=hot_pairs))
    assert Counter(found) == Counter(brute_alignment([r[:2] for r in rows]))


def test_large_groups(monkeypatch):
    a, b = np.array([1, 2, 1, 3, 4]), np.array([7, 7, 8, 9])
    ends_a, ends_b = np.array([1, 2, 3, 5, 6]), np.array([2, 4, 5, 6])
    found = alignment.Aligned(a, b, ends_a, ends_b, np.array([0, 4, 5]), np.array([0, 3, 4]))
    assert found.written([f"{i}{m}" for m in ",|;" for i in range(10)]) == ["1,2|7;1,3|7,8", "4|9", ""]
    want = [v.tolist() for v in found.links()]
    monkeypatch.setattr(alignment, "GROUP_LINKS", 1)
    assert [v.tolist() for v in found.links()] == want
    assert want[0] == [0] * 5 + [1] and sum(want[2]) == 2 * 1 + 2 * 2 + 1


@given(st.sets(st.integers(1, 300)), st.sets(st.integers(1, 300)), st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_gallop(a, b, guess):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    first, second = alignment.common_ends(a, b, np.array([0]), np.array([0]))
    assert a[first].tolist() == b[second].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    if len(b):
        start = np.full(len(a), min(guess, len(b)))
        assert alignment.gallop(a, b, start).tolist() == np.searchsorted(b, a).tolist()


# Collocations


def brute_collocations(rows, least=30, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, count in counts.items():
        candidates = [p for p in count if len(p) > 1 and count[p] >= least]
        parts = [(q[i : i + k], q) for q in candidates for k in range(2, len(q)) for i in range(len(q) - k + 1)]
        gone = {p for p, q in parts if 100 * count[q] >= 80 * count[p]}
        scored = []
        for p in candidates:
            if p not in gone:
                score, k = min((2_000_000 * count[p] // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, total[lang], -score


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(9)
    words = ["x", "Y", "zz", "é", ".", "q, r", "the Cat sat", "on\tthe mat;", "a\x01b", "\x0b", "\xa0"]
    rows = [(rng.choice(["a", "a", "b", None]), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 300])))) for _ in range(250)]
    rows += [("a", None), ("b", ""), (None, None), ("empty", ""), ("a", "X y X y"), ("a", "X y X y")]
    return spark.createDataFrame([(*r, "z") for r in rows], "lang string, text string, n string").repartition(6), rows


@pytest.mark.parametrize(("least", "top", "trie"), [(5, 2000, 1 << 18), (30, 7, 20)])
def test_collocations(phrases, least, top, trie):
    """Once with one trie, once with many small ones and few ranks."""
    df, rows = phrases
    found = rows_of(collocations.collocations(df, least=least, top=top, trie_phrases=trie))
    assert sorted(found) == sorted(brute_collocations(rows, least, top)) and found


def test_collocations_without_filters(phrases, monkeypatch):
    """Filters that let most keys pass cost time, not results."""
    df, rows = phrases
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 15)
    assert sorted(rows_of(collocations.collocations(df, least=8))) == sorted(brute_collocations(rows, 8))


@pytest.mark.parametrize("size", [7, 10, 50, 200, 1000])
def test_slices_of_long_texts(size):
    data = ("the cat sat . on the mat; " * 40 + "x" * 90 + " a b ").encode()
    whole, own, at = collocations._tokens(data), [], 0
    for tokens, n in collocations._slices(data, size):
        assert tokens == whole[at : at + len(tokens)]
        assert len(tokens) - n == 3 or at + len(tokens) == len(whole)
        own += tokens[:n]
        at += n
    assert own == whole


@given(st.lists(st.tuples(st.sampled_from("ab"), st.lists(st.sampled_from([b"u", b"v", b"w", b"x", b"y"]), min_size=2, max_size=4)), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_trie(entries):
    langs, lists = [lang for lang, _ in entries], [words for _, words in entries]
    trie = collocations.Trie(langs, lists)
    for lang in "ab":
        for first in (b"u", b"x", b"none"):
            for second in (b"v", b"y"):
                states = np.array([trie.roots.get(lang, -1)])
                for word in (first, second):
                    states = trie.step(states, np.array([trie.codes.get(word, 0)]))
                known = any(entry == lang and words[:2] == [first, second] for entry, words in entries)
                assert (states[0] >= 0) == known
    ends = {(lang, *words): int(end) for lang, words, end in zip(langs, lists, trie.ends, strict=True)}
    assert len(set(ends.values())) == len(ends)


def test_words_that_share_a_key_get_others(phrases, monkeypatch):
    """Short keys of the first seed name several words each; with the next seed all rows are right."""
    from pyspark.sql import functions as F

    df, rows = phrases
    seeds, real = [], collocations.coded

    def short(docs, lang, text, seed):
        seeds.append(seed)
        found = real(docs, lang, text, seed)
        return found if seed else found.withColumn("key", F.pmod("key", F.lit(3)) + 1)

    monkeypatch.setattr(collocations, "coded", short)
    assert sorted(rows_of(collocations.collocations(df, least=8))) == sorted(brute_collocations(rows, 8))
    assert seeds == [0, 1]


def test_trie_rows_do_not_grow_with_the_tasks(spark):
    """A phrase is sent once for each core, however many parts the texts have."""
    df = spark.range(400).selectExpr("'en' AS lang", "'a b c' AS text").repartition(40)
    words, texts = collocations.coded_words(df, "lang", "text")
    keys = {r.word: r.key for r in words.collect()}
    parts = [[keys["a"], keys["b"]], [keys["b"], keys["c"]], [keys["a"], keys["b"], keys["c"]]]
    candidates = spark.createDataFrame([(len(p), i, p) for i, p in enumerate(parts)], "words int, key long, parts array<long>")
    sent = []
    real = collocations.materialise
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "materialise", lambda frame, name="": sent.append(frame._jdf.queryExecution().optimizedPlan().toString()) or real(frame, name))
        (counted,) = collocations._counted(texts, candidates, 4, 10)
    assert "Repartition" in sent[0] and {r.key: r.n for r in counted.collect()} == {0: 400, 1: 400, 2: 400}


def test_the_driver_keeps_nothing_of_a_trie(spark, monkeypatch):
    """Counts of a block are a stored table, its broadcast goes before the next block's comes, and each phrase is in one block."""
    from pyspark import Broadcast, SparkContext

    df = spark.range(40).selectExpr("'en' AS lang", "'a b c d a c' AS text")
    words, texts = collocations.coded_words(df, "lang", "text")
    keys = {r.word: r.key for r in words.collect()}
    phrases = ["a b", "a c", "a b c", "a b c d", "b c", "c d", "c d a", "d a c", "d b", "a d"]
    rows = [(len(p.split()), i, [keys[w] for w in p.split()]) for i, p in enumerate(phrases)]
    candidates = spark.createDataFrame(rows, "words int, key long, parts array<long>")
    live, most = set(), []
    sent, gone = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        out = sent(self, value)
        live.add(id(out))
        most.append(len(live))
        return out

    def destroy(self, blocking=False):
        live.discard(id(self))
        gone(self, blocking)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    parts = collocations._counted(texts, candidates, 4, 3)
    assert len(parts) > 2 and max(most) == 1 and not live
    plans = [p._jdf.queryExecution().optimizedPlan().toString() for p in parts]
    assert all("Relation" in p and "LocalRelation" not in p and "LogicalRDD" not in p and "Join" not in p for p in plans)
    found = [(r.words, r.key, r.n) for p in parts for r in p.collect()]
    assert sorted(found) == [(w, k, 40) for w, k, _ in sorted(rows) if phrases[k] in "a b c d a c"]
    assert [sum(candidates.filter(b).count() for b in collocations._blocks(candidates, limit)) for limit in (1, 3, 100)] == [len(rows)] * 3
