"""Corpus operators against brute force and SQL, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.llm import (
    chat, components, decontaminate, exact_dedup, licenses, pieces, quality, queries, sharding, simhash, substrings, token_counts,
)

SPACE = r"[\x20\x09-\x0D]+"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "kept row_id shard text_sha256 recipe key name order print words"


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves, some of them null."""
    extra = ", ".join(f"`{n}` string" for n in NAMES.split())
    rows = [(ids[i] if ids else i, t, *["x" if i % 2 else None] * len(NAMES.split())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def hard(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "end."]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 14, 40, 90]))) for _ in range(40)]
    texts = [None, "", " ", "\n\t", None, ""] + base + base[:9]
    texts += [b.replace(" ", "\n  ", 2) for b in base[:7]] + [base[3] + " " + base[4], base[5] + " tail", "a " * 40, "a " * 55]
    texts += [base[8] + " " + " ".join(rng.choices(vocabulary, k=3000)) + " " + base[9]]
    ids = list(range(len(texts)))
    ids[10], ids[11], ids[50] = None, None, ids[49]
    return table(spark, texts, ids), list(zip(ids, texts, strict=True))


def asdicts(df):
    return [r.asDict() for r in df.collect()]


def key(row_id):
    return (row_id is None, row_id or 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, small, name):
    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted((tuple(v) for v in frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)

    assert rows(queries.QUERIES[name](spark, small).toPandas()) == rows(duck.sql(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, small, tmp_path, name):
    for t in ("documents", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_decontamination", "op6_sharding"])
def test_native(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(spark, hard, bits):
    """With three bits most chunks share a name, and identifiers come from the comparison of texts."""
    df, rows = hard
    got = exact_dedup.exact_groups(df, name_bits=bits).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, " ", t or "")].append(i)
    assert len(got) == len(rows)
    want = Counter()
    for text, ids in groups.items():
        first = min(ids, key=key)
        for i in ids:
            want[i, first, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    stay = exact_dedup.drop_exact_copies(df)
    assert stay.columns == df.columns and stay.count() == len(groups)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .!\n", max_size=3000), min_size=1, max_size=5))
def test_chunks_rebuild(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", exact_dedup.chunks(F.col("t"), 16, 64))
    assert all("".join(r.c) == r.t and all(len(c) <= 70 for c in r.c) for r in df.collect())


def plain_words(text):
    return WORDS.findall(re.sub(r"[^\w\x20\x09-\x0D]|_", "", (text or "").lower()))


def plain_shingles(words, size):
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if words and size else set()


@pytest.mark.parametrize("block_bytes", [16 << 20, 2000])
def test_contained(spark, hard, block_bytes):
    df, rows = hard
    texts = [t for _, t in rows]
    some = [t.split() for t in texts[6:40] if t and len(t.split()) > 12]
    items = [(k, " ".join(w)) for k, w in enumerate(some)] + [(90, None), (91, ""), (92, "w1 w2"), (94, "W3!"), (95, " ".join(some[2][4:7])), (96, " ".join(some[3][-4:])), (97, "w1 not there"), (93, " ".join(some[0][:-2] + ["other"])), (0, " ".join(some[0]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("hash", F.lit(1))
    got = Counter((r.doc_id, r.item_id, r.shared) for r in decontaminate.contained_items(df, bench, block_bytes=block_bytes).collect())
    want, guilty = Counter(), 0
    for i, t in rows:
        before = sum(want.values())
        for k, text in dict(items).items():
            size = min(5, len(plain_words(text)))
            mine, theirs = plain_shingles(plain_words(t), size), plain_shingles(plain_words(text), size)
            if theirs and 5 * len(mine & theirs) >= 4 * len(theirs):
                want[i, k, len(mine & theirs)] += 1
        guilty += sum(want.values()) > before
    assert got == want and len(want) > 20
    assert {k for _, k, _ in want} >= {92, 94, 95, 96} and sum(n for (_, k, _), n in want.items() if k == 94) > 5
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows) - guilty


def test_short_items(spark):
    """Items of one to four words are found inside longer texts, and only where their words stand in a row."""
    docs = table(spark, ["We say the answer is forty two, and go on", "forty, two", "two forty", "the answer", None, "Forty"])
    bench = spark.createDataFrame([(1, "answer is forty two"), (2, "Forty two."), (3, "forty"), (4, "the answer"), (5, "say answer")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (2, 3), (3, 4), (5, 3)]


def test_broadcast_bytes(spark, monkeypatch):
    """An item is broadcast once, not once for each hash of its sketch."""
    text = " ".join(f"v{i}" for i in range(1000))
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(decontaminate.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    bench = spark.createDataFrame([(1, text), (2, "one two three four five six")], "item_id long, text string")
    got = decontaminate.contained_items(table(spark, [text, "x " + text]), bench, block_bytes=100_000)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 1), (1, 1)]
    assert 0 < sum(len(s) for df in sent for r in df.collect() for s in r.asDict().get("shingles") or []) < 100_000


def test_shards(spark, hard):
    df, rows = hard
    big = df.unionAll(table(spark, [f"text {i}" for i in range(5000)], list(range(1000, 6000))))
    got = sharding.assign_shards(big, [1.0] * 24).collect()
    text = {i: t for i, t in rows if i is not None}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
               for r in got if r.doc_id in text and r.doc_id != rows[49][0])
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 100 < sum(r.grown_shard == 24 for r in got) < 320
    places = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            places[r.doc_id].add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    double = Counter(r.shard for r in sharding.assign_shards(big, [1.0, 2.0, 0.0, 1.0]).collect())
    assert 2 not in double and 1.7 < double[1] / double[0] < 2.3
    with pytest.raises(ValueError):
        sharding.assign_shards(big, [])


def plain_print(text):
    words = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(a) for a in range(n)]


def test_simhash(spark, hard):
    df, rows = hard
    got = simhash.near_groups(df).collect()
    prints = {t: plain_print(t) for _, t in rows}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{prints[t]:016x}") for i, t in rows)
    values = [prints[t] for _, t in rows]
    edges = [(a, b) for a in range(len(rows)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 2]
    part = plain_components(len(rows), edges)
    least = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p), key=key) for p in set(part)}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((rows[i][0], least[part[i]]) for i in range(len(rows)))
    assert sum(r.kept for r in got) == len(least)
    assert simhash.drop_near_copies(df).count() == len(least)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("paired", [2, 1000])
def test_links(spark, distance, paired):
    """Clusters of flipped bits; with two members a bucket everything goes through changed bits."""
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(14)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "print long"), distance, paired=paired)
    found = [(r.u, r.v) for r in links.collect()]
    mask = (1 << 64) - 1
    assert all(((u & mask) ^ (v & mask)).bit_count() <= distance for u, v in found)
    at = {v: i for i, v in enumerate(signed)}
    real = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= distance]
    mine, theirs = (plain_components(len(values), e) for e in ([(at[u], at[v]) for u, v in found], real))
    assert len(set(mine)) == len(set(theirs)) == len(set(zip(mine, theirs, strict=True)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 60)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    part = plain_components(500, edges)
    for a, b in edges:
        assert a == b and a not in got or got[a] == got[b]
    assert len(set(got.values())) == len({part[n] for n in got}) and all(got[n] <= n for n in got)


def plain_cut(rows, window):
    owner = {}
    order = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    words = [WORDS.findall(t or "") for _, t in rows]
    for o, w in zip(order, words, strict=True):
        for p in range(len(w) - window + 1):
            s = tuple(w[p : p + window])
            owner[s] = min(owner.get(s, o), o)
    for (i, _), o, w in zip(rows, order, words, strict=True):
        gone = {q for p in range(len(w) - window + 1) if owner[tuple(w[p : p + window])] < o for q in range(p, p + window)}
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("window, held", [(13, 1 << 21), (13, 40), (4, 500)])
def test_repeats(spark, hard, window, held):
    """Whether a task combines all its rows or a few at a time."""
    df, rows = hard
    got = substrings.remove_repeats(df, window=window, held_rows=held).collect()
    want = Counter(plain_cut(rows, window))
    assert Counter(tuple(r) for r in got) == want and sum(w[2] > 0 for w in want) > 10


def test_parse_in_parts():
    """Long texts in parts choose the same symbols, and equal windows the same one anywhere."""
    rng = random.Random(5)
    words = [b"w%d" % rng.randint(0, 9) for _ in range(4000)] + [b"x"] * 300 + [b"w%d" % rng.randint(0, 9) for _ in range(500)]
    whole = next(substrings._parsed([(0, b" ".join(words))], 13))
    parts = list(substrings._parsed([(0, b" ".join(words))], 13, 500))
    assert len(parts) > 5
    assert np.array_equal(np.concatenate([p.names for p in parts]), whole.names)
    assert np.array_equal(np.concatenate([p.places for p in parts]), whole.places)


def test_parse_alone():
    """A short passage parsed alone names its windows as within a long text, even if a round joins nothing that fits."""
    rng = random.Random(9)
    words = [b"v%d" % rng.randint(0, 5000) for _ in range(6000)]
    whole = next(substrings._parsed([(0, b" ".join(words))], 13))
    for n in (13, 14, 20):
        for at in range(0, 5900, 7):
            alone = next(substrings._parsed([(0, b" ".join(words[at : at + n]))], 13))
            assert np.array_equal(alone.names, whole.names[at : at + n - 12]), (n, at)
    named = {}
    for p, name in zip(whole.places.tolist(), whole.names.tolist(), strict=True):
        assert named.setdefault(tuple(words[p : p + 13]), name) == name
    assert len(set(whole.names.tolist())) < 0.6 * len(whole.names)


def test_pieces(spark, hard):
    df, rows = hard
    texts = [t or "" for _, t in rows] + ["  two  spaces ", "tab\tand\nline", "▁ already ▁▁", "😀 é \x00", "long word " * 9000]
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    for r in pieces.encode(table(spark, texts), queries.PIECE_MODEL).collect():
        text = texts[r.doc_id]
        data = text.encode()
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)
        assert all(a <= b for a, b in zip(r.begins, r.ends, strict=True)) and r.begins == sorted(r.begins)
        assert not r.ids or (r.begins[0] == 0 and r.ends[-1] == len(data) and r.ends[:-1] == r.begins[1:])
        if len(text) < 2000:
            for i, a, b in zip(r.ids, r.begins, r.ends, strict=True):
                piece = library.id_to_piece(i)
                assert library.is_byte(i) or data[a:b].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))
    got = {r.doc_id: r for r in pieces.digests(table(spark, texts), queries.PIECE_MODEL).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = pieces.decode(pieces.encode(table(spark, texts[:3] + texts[-4:]), queries.PIECE_MODEL), queries.PIECE_MODEL)
    assert {r.text for r in back.collect()} == {library.decode(library.encode(t)) for t in texts[:3] + texts[-4:]}


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc_cf"])
def test_character_map(rule):
    """The compiled map, walked by hand, gives what the library's own normaliser gives."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = proto.ModelProto()
    model.ParseFromString(made.serialized_model_proto())
    normalise = pieces.Normaliser(model.normalizer_spec)
    for text in ("Ｆｕｌｌ　width ﬁne", "①½ Äpfel é", " plain  text ", "", "한글 ｶﾞ"):
        out, align = normalise(text.encode())
        assert out.decode() == made.normalize(text)
        assert len(align) == len(out) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(text.encode())


def test_quality(spark, small):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]

    def text(grade):
        w = rng.choices(words, k=rng.randint(8, 120))
        if grade == 0:
            w[rng.randrange(len(w))] = rng.choice(["rude", "nasty"])
        return " ".join(x + "***" if grade == 1 else x for x in w)

    grades = [rng.choice([0, 1, 2, 2, 2]) for _ in range(1500)]
    docs = table(spark, [text(g) for g in grades] + [None, ""])
    labels = spark.createDataFrame(
        [(i, int(g == 2), int(g == 0)) for i, g in enumerate(grades[:1000])] + [(None, 1, 0), (5, None, None), (7, None, 1)],
        "doc_id long, quality int, toxic int",
    )
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = range(1000, 1500)
    right = [got[i].kept == (grades[i] == 2) for i in held]
    assert sum(right) > 0.95 * len(right)
    assert all(0 <= got[i].expected_grade <= 2 and (got[i].tail_probability >= 0.5) == got[i].kept for i in held)
    assert len(got) == 1502 and quality.keep_good(docs, labels).columns == docs.columns
    unfitted = quality.quality(docs, labels.limit(0))
    assert unfitted.filter("kept AND expected_grade IS NULL").count() == 1502


def test_repeated_ids(spark):
    """Scores do not depend on the order of rows, also where an id has several texts; the least digest counts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    rows = [(i % 100, " ".join(rng.choices(words, k=12) + ["bad"] * (i % 3 == 0))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")

    def scores(order, parts):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        return Counter(map(tuple, quality.quality(docs, labels).collect()))

    first = scores(rows, 1)
    assert first == scores(rows[::-1], 7)
    least = {i: min((t for j, t in rows if j == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in range(100)}
    model = quality.train(spark.createDataFrame(list(least.items()), "doc_id long, text string"), quality.graded(labels))
    assert first == Counter((i, *quality.score(model, t.encode()), quality.score(model, t.encode())[1] >= quality.KEEP_FROM) for i, t in rows)


def test_ordinal_gradient():
    """The fit finds the shifted thresholds of data drawn from the model."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 4000)
    rows = [(np.array([0, 1 + k]), np.array([1.0, 1.0], np.float32)) for k in x]
    chance = np.stack([1 / (1 + np.exp(-(t - np.where(x, 2.0, -2.0)))) for t in (-1, 1)])
    grades = (rng.random(4000) > chance).sum(0)
    model = quality.fit(rows, grades, dimensions=8, rounds=400, penalty=0.01)
    weights = dict(zip(model.index.tolist(), model.weights.tolist(), strict=True))
    assert abs(weights[2] - weights[1] - 4) < 0.4 and abs(model.thresholds[1] - model.thresholds[0] - 2) < 0.3


def test_chat(spark, small):
    talks = spark.read.parquet(f"{small}/conversations.parquet")
    lines = chat.transcript_lines(talks)
    model = chat.train(lines)
    truth = {(r.conv_id, r.turn, r.line): (r.role, r.opens) for r in lines.collect()}
    got = chat.parse_lines(lines, model).collect()
    assert len(got) == len(truth)
    assert sum(truth[r.conv_id, r.turn, r.line] == (r.role, r.opens) for r in got) > 0.9 * len(got)
    whole = defaultdict(str)
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn, r.line)):
        whole[r.conv_id] += r.rendered
    assert all(re.fullmatch(r"(<\|\w+\|>\n(?:(?!<\|end\|>).*\n)*<\|end\|>\n)+", t) for t in whole.values())


def test_chat_blocks(spark, monkeypatch):
    """One conversation over many blocks decodes as in one pass; nulls, ties and repeats stay."""
    rng = random.Random(4)
    said = ["User: why?", "so it goes", "Assistant: yes.", "", None, "System: be kind", "AI: no", "what is it?"]
    rows = [(1, i, 0, rng.choice(said)) for i in range(900)] + [(None, 0, 0, "User: hi"), (2, None, None, None), (3, 1, 1, "Q: x?"), (3, 1, 1, "Q: x?")]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, line long, text string").withColumn("conv", F.lit("other"))
    model = chat.fit(chat.pd.DataFrame({"conv": [], "role": [], "opens": [], "symbol": []}))
    monkeypatch.setattr(chat, "BLOCK_LINES", 60)
    got = chat.parse_lines(lines, model).collect()
    assert len(got) == len(rows)
    symbols = np.array([chat.symbol(t or "") for c, _, _, t in rows if c == 1])
    states = chat._best(model, symbols, None, None)
    mine = [(r.role, r.opens) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn)]
    assert mine == [(model.roles[s // 2], s % 2 == 0) for s in states]


def test_chat_rare_roles(spark):
    """A role that the fitted lines lack is still a state, and its lines are told by what they look like."""
    rows = [(c, t, 0, *(("Human: why?", "user"), ("AI: so it goes.", "assistant"))[t % 2], True) for c in range(40) for t in range(10)]
    rows += [(c, 10, 0, "Tool: 42", "tool", True) for c in range(40)]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, line long, text string, role string, opens boolean")
    model = chat.train(lines, 10)
    assert set(model.roles) == {"assistant", "system", "tool", "user"}
    assert [(r.role, r.opens) for r in chat.parse_lines(lines, model).filter("turn = 10").collect()] == [("tool", True)] * 40


def test_counts(spark, hard):
    df, rows = hard
    counter = token_counts.load(queries.VOCABULARY)
    edited = queries.edits_of(df)
    got = token_counts.edited_counts(edited, queries.VOCABULARY).collect()
    for r, (_, text) in zip(got, rows, strict=True):
        assert r.n_tokens == counter.count(text or "")
    assert sum(r.n_encoded for r in got if r.n_chars > 8000) < 0.5 * sum(r.n_chars for r in got if r.n_chars > 8000)
    trees = token_counts.count_trees(df, queries.VOCABULARY).collect()
    assert all(t.tokens[1] == t.n_tokens and t.chars[1] == len(x or "") for t, (_, x) in zip(trees, rows, strict=True))
    edits = spark.createDataFrame([(6, 2, 0, 0, "y"), (6, 1, 0, 3, "x ")], "doc_id long, order int, start int, stop int, text string")
    assert [e.text for e in token_counts.with_edits(df, edits).filter("doc_id = 6").first().edits] == ["x ", "y"]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_tree_edits(data):
    letters = st.text(alphabet="ab '.\n1é  ", max_size=120)
    text = data.draw(letters)
    tree = token_counts.CountTree(text, token_counts.load(queries.VOCABULARY), size=8)
    for _ in range(data.draw(st.integers(1, 5))):
        a = data.draw(st.integers(-2, len(text) + 3))
        b = data.draw(st.integers(-2, len(text) + 3))
        new = data.draw(letters)
        start = min(max(a, 0), len(text))
        text = text[:start] + new + text[min(max(b, start), len(text)) :]
        tree.edit(a, b, new)
        assert tree.text == text and tree.total == tree.counter.count(text)


def test_vocabulary_is_whole():
    counter = token_counts.load(queries.VOCABULARY)
    assert isinstance(counter._encoding, tiktoken.Encoding) and counter.count("hello world") == 2


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    texts = [None, "", "Some text.\nReleased under the  MIT license.\nMore.", apache, apache.replace(";", "; One odd sentence here."),
             "you may not use this file except in compliance with the License. " + apache[:70], "We like the MIT License.", "x " * 50000 + "\nLicensed under CC BY-NC 4.0."]
    got = licenses.license_notices(table(spark, texts)).collect()
    assert {(r.doc_id, r.licence) for r in got} == {(2, "MIT"), (3, "Apache-2.0"), (4, "Apache-2.0"), (7, "CC-BY-NC-4.0")}
    assert all(texts[r.doc_id][r.start : r.end].strip() == texts[r.doc_id][r.start : r.end] != "" for r in got)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("notice, licence", [(MIT, "MIT"), (BSD, "BSD-3-Clause"), (GPL, "GPL-3.0-or-later")])
def test_wrapped_licenses(notice, licence):
    """As published, in one line, and behind the comment marks of several languages; blank lines still part sentences."""
    find = licenses.Matcher().find
    lines = notice.split("\n")
    for text in [
        notice, notice.replace("\n", "\r\n"), " ".join(notice.split()), notice.replace("3. N", "(c) N"), "x\n" + notice + "\ny",
        *("\n".join((mark + line).rstrip() for line in lines) for mark in ("# ", " * ", "// ", ";; ", "-- ", "dnl ", "C     ")),
        *("\n".join(f"{mark}{line:<80}{mark}" for line in lines) for mark in ("*", "##")),
    ]:
        (got,) = find(f"Some words.\n\n{text}\n\nMore words.")
        assert got[0] == licence and normal(got, f"Some words.\n\n{text}\n\nMore words.")
    assert not find(notice.replace("\n", "\n\n"))
    assert not find(notice.replace(" the ", " their "))


def normal(got, text):
    """The characters of a notice run from its first to its last known word."""
    rule = licenses.RULES[got[1]].sentences
    words = licenses.normalised(text[got[2] : got[3]])
    return words.startswith(licenses.normalised(rule[0])[:10]) and words.endswith(licenses.normalised(rule[-1])[-10:])


def test_license_lines():
    """One line is enough, whatever its neighbours; so are wrapped short notices; unknown sentences count against the gap."""
    find = licenses.Matcher().find
    assert [m[0] for m in find("no mark\nLicensed under CC BY 4.0\nno mark")] == ["CC-BY-4.0"]
    assert [m[0] for m in find("Licensed under\nCC BY-NC\n4.0.")] == ["CC-BY-NC-4.0"]
    assert not find("I released under the MIT License.") and not find("Licensed under\n\nthe MIT License.")
    first, last = BSD.split("\n\n")[0], BSD.split("\n\n")[-1]
    for n in range(7):
        odd = "".join(f"{i + 1}. A clause\n   of two lines.\n" for i in range(n))
        assert bool(find(f"{first}\n{odd}{last}")) == (n <= 4)


def test_license_table(spark, small):
    """Single-sentence rules by plain search."""
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    got = {(r.doc_id, r.licence) for r in queries.op9_license_scan(spark, small).collect()}
    want = {(d, r.licence) for d, t in zip(docs.doc_id, docs.text, strict=True) for r in licenses.RULES
            if len(r.sentences) == 1 and r.sentences[0] in t}
    assert want and want == got


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in corpus_pipeline.run(spark, small).collect()}
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_collocation_words_travel_in_small_batches():
    from labelweave.llm import collocations as c

    words = c._Words("en", 0)
    words.add(b" ".join(b"w%d" % i for i in range(2 * c.SENT_WORDS + 5)))
    words.add(b"w1 w1")
    batches = [b for b in words.rest() if b["word"].null_count == 0]
    assert max(b.num_rows for b in batches) <= c.SENT_WORDS
    counts = {w: n for b in batches for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist(), strict=True)}
    assert len(counts) == 2 * c.SENT_WORDS + 5 and counts["w1"] == 3 and counts["w2"] == 1
