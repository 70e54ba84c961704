"""Language identification: held-out accuracy, odd rows and a plain re-statement of the sizes."""

import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from sightline.llm import language

SCHEMA = "doc_id long, text string, lang string"
STEMS = {
    "en": "the of and that with from have this which were their would there about other ing tion ly be to".split(),
    "de": "der die und das nicht ein sich auch wird über für durch werden können schaft keit lich ung zu im".split(),
    "fr": "le les des une est pour que dans avec sont être était où même tion eux ment ai ou en".split(),
}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(STEMS[lang]) + (r.choice(STEMS[lang]) if r.random() < 0.4 else "") for _ in range(n)).capitalize() + "."


def out_of_fit(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus():
    return [(i, text(lang, 5 + i % 90, i), lang) for i, lang in enumerate(["en", "en", "de", "fr"] * 60)]


def test_held_out_texts_are_recognised(spark, corpus):
    rows = [*corpus, *((k, t.upper() + " 123 !!", lang) for k, t, lang in [(1000 + i, *r[1:]) for i, r in enumerate(corpus[:40])])]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))).collect()}
    assert all(got[i]["held_out"] == out_of_fit(i) for i, _, _ in rows)
    held = [(i, lang) for i, _, lang in rows if out_of_fit(i)]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [r["rejected"] for r in got.values()].count(True) < 0.2 * len(rows)


def test_sizes_and_score_restated(spark, corpus):
    model = language.learn(spark.createDataFrame(corpus, SCHEMA))
    assert model.names[0] == "en" and set(model.names) == set(STEMS)
    assert all(len(t) <= language.DICTIONARY for t in model.texts)
    sample = text("fr", 3000, 9)
    data = language.plain(sample)
    how = zstandard.ZstdCompressionParameters.from_level(language.LEVEL, min_match=language.SHORTEST, write_checksum=False, write_content_size=False, write_dict_id=False)
    want = []
    for t in model.texts:
        total = 0
        for k in range(0, len(data), language.BLOCK):
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            total += len(c.compress(data[k : k + language.BLOCK]))
        want.append(total)
    assert [abs(a - b) <= 0.02 * b for a, b in zip(model.sizes(sample), want, strict=True)] == [True] * 3
    assert model.predict(sample)[0] == model.names[want.index(min(want))] == "fr"


def test_labels_and_ids_of_held_out_rows_teach_nothing(spark, corpus):
    plain = language.learn(spark.createDataFrame(corpus, SCHEMA))
    other = language.learn(spark.createDataFrame([(i, t + " zzz" if out_of_fit(i) else t, "xx" if out_of_fit(i) else lang) for i, t, lang in corpus], SCHEMA).repartition(7))
    assert plain == other


def test_copies_change_no_dictionary_but_the_share(spark, corpus):
    more = [*corpus, *((i, *corpus[1][1:]) for i in range(2000, 2100))]
    model = language.learn(spark.createDataFrame(more, SCHEMA))
    assert model.texts == language.learn(spark.createDataFrame(corpus, SCHEMA)).texts


def test_odd_rows(spark, corpus):
    odd = [(500, None, "en"), (501, "", None), (502, "12 34 ²½ !!", "en"), (None, "the of and that", None), (503, "a", "de"), (503, "a", "de"), (504, "the of and that with " * 50_000, None)]
    got = language.identify(spark.createDataFrame([*corpus, *odd], SCHEMA)).where("doc_id IS NULL OR doc_id >= 500").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(odd)
    assert all((by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True) for i in (500, 501, 502))
    assert by[None]["lang_pred"] == by[504]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert by[503]["lang_pred"] in STEMS


def test_nothing_to_learn_from(spark):
    assert language.identify(spark.createDataFrame([], SCHEMA)).collect() == []
    got = language.identify(spark.createDataFrame([(1, "some words", None), (2, None, "en")], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    one = language.identify(spark.createDataFrame([(1, "some words", "en"), (3, "more of it", None)], SCHEMA)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0)}
