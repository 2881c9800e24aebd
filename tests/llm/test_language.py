"""Language identification: rare and whole labels, the rejection floor, and the fusion against plain Python."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import pytest

from tidemark.llm import language
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
EN = "the and of that with from this have were which their there about would other into time people after could".split()
FI = "joka mutta niin kuin hän ovat tämä kaikki sitten vielä nyt myös yksi kaksi kolme vuosi työ talo metsä järvi".split()
FIL = "ang mga ng sa ay hindi kanyang kung para lamang mayroon dahil nang siya tayo bahay gubat lawa taon trabaho".split()


def sentence(words, seed, n=25):
    return " ".join(random.Random(seed).choices(words, k=n))


def test_rare_language_is_learnt_and_codes_are_compared_whole(spark):
    """Three of 3,600 rows, with ids after all others by MD5, and a code that starts like another."""
    ids = sorted(range(3600), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rare = set(ids[-3:])
    rows = [(i, sentence(FIL, i), "fil-PH", "b") if i in rare else (i, sentence(FI, i), "FI", "b") if i % 2 else (i, sentence(EN, i), "en_US", "a") for i in ids]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(docs)
    assert model.languages == ["en", "fi", "fil"]
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert not [(i, found[i]) for i in ids if found[i].language != ("fil" if i in rare else "fi" if i % 2 else "en") or not found[i].accepted]


def test_language_of_long_texts_only_is_learnt(spark):
    rows = [(i, sentence(EN, i), "en", "a") for i in range(20)] + [(30, sentence(FI, 1, 60000), "fi", "b")]
    assert language.train(spark.createDataFrame(rows, SCHEMA)).languages == ["en", "fi"]


def test_one_odd_row_does_not_set_the_floor(spark):
    odd = "".join(random.Random(5).choices("qxzjkvwpy ", k=300))
    docs = spark.createDataFrame([(i, sentence(EN, i), "en", "a") for i in range(200)] + [(999, odd, "en", "a")], SCHEMA)
    found = {r.doc_id: r.accepted for r in language.identify(docs, language.train(docs)).collect()}
    assert [i for i, accepted in found.items() if not accepted] == [999]


def test_page_evidence_reads_whole_codes(spark):
    pages = spark.createDataFrame([(1, "http://a.ph/", "<html lang='fil-PH'>x</html>"), (2, "http://a.fi/", '<HTML class=x lang="fi">x</html>'), (3, "http://a.fi/", "<html>x</html>")], "page_id long, url string, html string")
    rows = language.page_evidence(pages).select("page_id", language.language_code("declared").alias("code")).collect()
    assert {r.page_id: r.code for r in rows} == {1: "fil", 2: "fi", 3: None}


def test_fusion(spark):
    """op8_language against plain Python: likelihoods, hosts' priors, declared languages, quantile and rejection."""
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang, source FROM '{SF}/documents.parquet'").fetchall()
    grams = {}
    for i, text, _, _ in rows:
        body = b" " + b" ".join("".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).encode().split()) + b" "
        codes = [(body[j] | body[j + 1] << 8 | body[j + 2] << 16) * 2654435761 % 2**32 >> 17 for j in range(len(body) - 2)]
        grams[i] = Counter(codes)
    names = sorted({x for _, _, x, _ in rows if x})
    counts = {x: Counter() for x in names}
    for i, _, lang, _ in rows:
        if lang:
            counts[lang].update(grams[i])
    totals = {x: sum(c.values()) for x, c in counts.items()}
    seen = {g for own in grams.values() for g in own}
    common = {g: (sum(counts[x][g] / totals[x] for x in names) / len(names) + 2**-15) / 2 for g in seen}
    log = {(x, g): math.log(0.9 * counts[x][g] / totals[x] + 0.1 * common[g]) for x in names for g in seen}
    text = {i: {x: sum(n * log[x, g] for g, n in own.items()) for x in names} for i, own in grams.items()}
    vote = {i: max(names, key=text[i].get) if grams[i] else None for i in grams}
    everyone, by_host = Counter(v for v in vote.values() if v), {}
    for i, _, _, source in rows:
        by_host.setdefault(source, Counter())[vote[i]] += 1
    size = {i: sum(own.values()) for i, own in grams.items()}
    means = sorted(max(text[i].values()) / size[i] for i in grams if size[i] >= 20)
    floor = means[math.ceil(0.05 * len(means)) - 1] - 2.5
    found = {r.doc_id: r for r in QUERIES["op8_language"](spark, SF).collect()}
    for i, _, lang, source in rows:
        prior = dict.fromkeys(names, 1 / len(names))
        for level in (everyone, everyone, by_host[source]):  # no address suffix: its group is all rows
            own = {x: level[x] - (vote[i] == x) for x in names}
            prior = {x: (own[x] + 20 * prior[x]) / (sum(own.values()) + 20) for x in names}
        logs = {x: text[i][x] + math.log(prior[x]) + ((math.log(0.9) if x == lang else math.log(0.1 / (len(names) - 1))) if lang in names else 0) for x in names}
        best = max(names, key=logs.get)
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert found[i].language == best and found[i].confidence == pytest.approx(share, rel=1e-6)
        assert found[i].accepted == (size[i] > 0 and max(text[i].values()) / size[i] >= floor and share >= 0.6)
