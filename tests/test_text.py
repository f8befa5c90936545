
import pytest
from pyspark.sql import functions as F

from labelweave.functions import text
from labelweave.sources.writers import label_map_json
from labelweave.operators.labels import add_binary_label, label_map
from labelweave.operators.tables import drop_class, drop_missing, empty_to_null, require_text


def run(spark, expression, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("t"))).collect()]


SOFT = {
    "@né x": "x",
    "see http://a.b/c?d now www.x.y": "see now",
    "#tag <b>bold</b>": "tag bold",
    "x <a\nb> y": "x <a b> y",
    "hey\x1cyou": "hey you",
    "": "",
    "   ": "",
    "a   b\tc ": "a b c",
    "two  blanks": "two blanks",
}


def test_soft_clean(spark):
    assert run(spark, text.soft_clean, list(SOFT)) == list(SOFT.values())
    assert run(spark, text.soft_clean, [None]) == [None]
    assert run(spark, lambda c: text.soft_clean(text.as_text(c, True)), [None]) == ["nan"]


HOSTILE = {
    "\x85a<b\x85c>d": "ad",
    "ＷＷＷ www.é ü": "ＷＷＷ ü",
    "a@b_c١ d": "a d",
    "x<\r>y": "xy",
    "😀<i>😀</i>": "😀😀",
    "http://é　z": "z",
    "a\u200bb  c": "a\u200bb c",
}


def test_soft_clean_of_hostile_texts(spark):
    hostile = list(HOSTILE)
    assert run(spark, text.soft_clean, hostile) == list(HOSTILE.values())
    assert run(spark, text.tokens, hostile) == [t.split() for t in hostile]
    assert run(spark, text.word_count, hostile) == [len(t.split()) for t in hostile]
    assert run(spark, lambda c: text.has_tokens(c, 4), hostile) == [len(t.split()) >= 4 for t in hostile]
    assert run(spark, text.is_blank, hostile) == [t.strip() == "" for t in hostile]


def test_squeeze(spark):
    assert run(spark, text.squeeze_repeats, ["sooo", "aaa😀😀😀😀", "a\n\n\nb", "aab"]) == ["soo", "aa😀😀", "a\n\n\nb", "aab"]


def test_counts(spark):
    assert run(spark, F.length, ["a😀"]) == [2]
    assert run(spark, text.emoji_count, ["a😀", ""]) == [1, 0]
    assert run(spark, text.word_count, [""]) == [0]
    assert run(spark, text.hashtag_count, ["#a #é # ##b"]) == [3]


def test_removals(spark):
    assert run(spark, text.remove_emoji, ["a😀🚀b🇮🇹"]) == ["ab"]
    assert run(spark, text.remove_non_ascii, ["aéb"]) == ["ab"]
    assert run(spark, text.remove_punctuation, ["a_b, c!é"]) == ["a_b cé"]


def test_contractions(spark):
    given = ["Don't  go, it's (can't) gonna", "We’re\nhere", "plain text", "él'x", "U ok?"]
    wanted = ["Do not  go, it is (cannot) going to", "We are\nhere", "plain text", "él'x", "You ok?"]
    assert run(spark, text.expand_contractions, given) == wanted


def test_lemmas_and_stop_words(spark):
    assert run(spark, text.lemmatise, ["stories boxes cats running hoped was thing"]) == ["story box cat run hop be thing"]
    assert run(spark, text.remove_stop_words, ["The cat AND a dog"]) == ["cat dog"]


def test_full_clean(spark):
    assert run(spark, text.full_clean, ["@you The caaaats aren't <b>running</b>!!! http://x.y"]) == ["caat run"]
    assert run(spark, text.full_clean, [None]) == [None]


def test_missing_values(spark):
    frame = spark.createDataFrame([("null", 1), ("Null", 2), ("", 3), (None, 4), ("x", 5)], "t string, n int")
    assert [r.n for r in drop_missing(empty_to_null(frame, ["t"]), ["t"]).collect()] == [2, 5]
    with pytest.raises(KeyError):
        drop_missing(frame, ["absent"])
    with pytest.raises(TypeError):
        require_text(frame, "n")


def test_labels(spark):
    frame = spark.createDataFrame([("b", 0), ("a", 1), (None, 2), ("a", 3)], "l string, i int")
    assert [r.y for r in add_binary_label(frame, "l", "a", "y").orderBy("i").collect()] == [1, 0, 1, 0]
    assert [r.i for r in drop_class(frame, "l", "a").orderBy("i").collect()] == [0, 2]
    names = ["religion", "age", "gender", "ethnicity", "not_cyberbullying"]
    mapping = label_map(spark.createDataFrame([(n,) for n in names], "l string"), "l")
    assert {r.l: r.code for r in mapping.collect()} == {n: i for i, n in enumerate(sorted(names))}
    assert label_map_json(mapping).first()[0] == '{"age":0,"ethnicity":1,"gender":2,"not_cyberbullying":3,"religion":4}'
