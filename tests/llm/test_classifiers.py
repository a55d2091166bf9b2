import math
import random

import pytest

from strandlake.llm import knn, langid
from tests.llm.common import awkward, documents

SYLLABLES = {"en": "the and ing ion er re on at".split(), "de": "der sch ung ein ü keit ß ge".split(), "fr": "le eau ou é que tion è an".split()}


def text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


def labelled(n):
    return [(i, text(lang := list(SYLLABLES)[i % 3], 30, i), lang, "s") for i in range(n)]


def test_languages_of_unseen_texts(spark):
    train, unseen = labelled(300), [(1000 + i, text(list(SYLLABLES)[i % 3], 20, 5000 + i), None, "s") for i in range(150)]
    out = langid.identify(documents(spark, unseen), documents(spark, train)).collect()
    right = sum(r.lang_pred == list(SYLLABLES)[(r.doc_id - 1000) % 3] for r in out)
    assert right >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_languages_awkward(spark):
    rows = [*awkward(), (20, "12345 !!!"), (21, text("de", 30, 1)), (22, "zzzz qqqq xxxx jjjj kkkk vvvv " * 5)]
    out = langid.identify(documents(spark, rows), documents(spark, labelled(90))).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    for i in (1, 2, 3, 6, 20):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[21].lang_pred == "de" and not got[21].rejected
    assert got[22].rejected and got[22].lang_pred in SYLLABLES
    assert langid.identify(documents(spark, []), documents(spark, labelled(9))).collect() == []
    assert {r.lang_pred for r in langid.identify(documents(spark, rows), documents(spark, [])).collect()} == {"und"}


def test_a_language_keeps_several_centroids():
    table = langid.letters()
    rows = [("a", *langid.terms(text(lang, 40, i).encode(), table)) for i in range(20) for lang in ("en", "de")]
    model = langid.Model([*rows, *(("b", *langid.terms(text("fr", 40, i).encode(), table)) for i in range(20))])
    assert (model.owner == 0).sum() > 1
    assert all(model.predict(text(lang, 40, 99).encode(), table)[0] == want for lang, want in (("en", "a"), ("de", "a"), ("fr", "b")))


def junk(lang, n, seed):
    r = random.Random(seed)
    return " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text(lang, n, seed).split())


def test_quality_of_unseen_texts(spark):
    train = [(i, junk("en", 40, i) if i % 4 == 0 else text("en", 40, i), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, label int")
    unseen = [(1000 + i, junk("de", 30, i) if i % 2 else text("de", 30, i), "de", "s") for i in range(100)]
    both = documents(spark, train + unseen)
    out = {r.doc_id: r.score for r in knn.quality_scores(both, labels).collect()}
    assert len(out) == 500 and all(0 <= s <= 1 for s in out.values())
    assert sum((out[1000 + i] >= 0.3) == (i % 2 == 0) for i in range(100)) >= 97


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 0)], "doc_id long, label int")
    rows = awkward()
    out = knn.quality_scores(documents(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert {r.score for r in out if r.doc_id in (1, 2, 3)} == {0.0}
    assert {r.score for r in knn.quality_scores(documents(spark, rows), labels.where("false")).collect()} == {0.0}
    assert knn.quality_scores(documents(spark, []), labels).collect() == []


@pytest.mark.parametrize("block", [1, 7, 512])
def test_scores_do_not_depend_on_blocks(block):
    texts = [text("en", 30, i).encode() for i in range(40)] + [junk("en", 30, i).encode() for i in range(40)]
    model = knn.Model([knn.terms(t) for t in texts], [1] * 40 + [0] * 40)
    some = texts[::3] + [texts[0], None, b"", b"  "]
    got = model.scores(some, block)
    assert (got == model.scores(some)).all() and list(got[-3:]) == [0, 0, 0] and got[0] == got[-4]


def test_votes_against_brute_force():
    """The vote by plain loops: all neighbours sorted by cosine, then by their place in the sample."""
    texts = [text("en", 30, i).encode() for i in range(40)] * 2 + [junk("en", 30, i).encode() for i in range(40)]
    labels = [1] * 40 + [0] * 10 + [1] * 30 + [0] * 40  # copies with other labels: ties
    model = knn.Model([knn.terms(t) for t in texts], labels)
    asked = [text("de", 20, i).encode() for i in range(20)] + [junk("de", 20, i).encode() for i in range(20)] + texts[:15]
    for data, got in zip(asked, model.scores(asked), strict=True):
        at, n = knn.terms(data)
        v = sum(w * model.axes[i] for i, w in zip(at, knn._weigh(at, n, model.idf)))
        length = sum(float(x) ** 2 for x in v) ** 0.5
        cosine = [round(sum(float(x) * float(y) for x, y in zip(v, u)) / length, knn.DIGITS) for u in model.vectors]
        best = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))[: knn.NEIGHBOURS]
        weight = [max(cosine[i], 1e-3) ** knn.POWER for i in best]
        assert abs(got - sum(w * model.labels[i] for w, i in zip(weight, best)) / sum(weight)) < 1e-6


def test_languages_against_brute_force():
    """The nearest of all centroids by plain loops, in whatever language it is."""
    table = langid.letters()
    model = langid.Model([(lang, *langid.terms(text(lang, 30, i).encode(), table)) for i in range(40) for lang in SYLLABLES])
    for i in range(60):
        data = text(list(SYLLABLES)[i % 3], 1 + i % 7, 700 + i).encode()
        at, n = langid.terms(data, table)
        weights = {int(k): (1 + math.log(c)) * float(model.idf[k]) for k, c in zip(at, n)}
        length = math.sqrt(sum(w * w for w in weights.values()))
        cosine = [sum(w * float(c[k]) for k, w in weights.items()) / length for c in model.centroids.T]
        lang, score, far, rejected = model.predict(data, table)
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert lang == model.langs[model.owner[best]] and abs(far - (1 - cosine[best])) < 1e-5
        top = {o: max(c for c, p in zip(cosine, model.owner) if p == o) for o in set(model.owner.tolist())}
        votes = {o: math.exp(langid.SHARPNESS * (c - max(top.values()))) for o, c in top.items()}
        assert abs(score - votes[int(model.owner[best])] / sum(votes.values())) < 1e-4 and rejected == (far > model.limits[best])


def test_many_languages(spark):
    rows = [(i, text("en", 10, i), f"x{i}", "s") for i in range(300)]
    out = langid.identify(documents(spark, rows[:20]), documents(spark, rows)).collect()
    assert all(r.lang_pred == f"x{r.doc_id}" for r in out)


def test_a_repeated_row_takes_no_other_languages_place(spark):
    train, unseen = labelled(300), [(1000 + i, text(list(SYLLABLES)[i % 3], 20, 5000 + i)) for i in range(60)]
    said = lambda extra: sorted((r.doc_id, r.lang_pred) for r in langid.identify(documents(spark, unseen), documents(spark, train + extra), 100).collect())
    alone = said([])
    assert said([(5, "aa bb cc dd " * 5, "aa", "s")] * 4000) == alone
    # all texts of a language under one id, and a row of another language that is half of it
    one_id = [(5, text("en", 30, 9000 + i), "en2", "s") for i in range(50)] + [(train[0][0], train[0][1], "en", "s")] * 1000
    got = langid.fit(documents(spark, train + one_id), 100)
    assert got.langs == ["de", "en", "en2", "fr"]
    assert sum(p == list(SYLLABLES)[(i - 1000) % 3] or p == "en2" for i, p in said(one_id)) >= 59


def test_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    dirty = [(2000 + i, f"word{i} only here", f"x{i}", "s") for i in range(40)]
    assert langid.fit(documents(spark, labelled(90) + dirty)).langs == ["de", "en", "fr"]


def test_a_repeated_id_takes_no_other_labels_place(spark):
    train = [(i, junk("en", 40, i) if i % 4 == 0 else text("en", 40, i)) for i in range(400)]
    labels = [(i, int(i % 4 != 0)) for i in range(400)]
    unseen = [(5000 + i, junk("de", 30, i) if i % 2 else text("de", 30, i)) for i in range(40)]
    hot = [(9000, text("en", 40, 7))] * 3000

    def scores(docs, known):
        out = knn.quality_scores(documents(spark, docs), spark.createDataFrame(known, "doc_id long, label int"), 200).collect()
        return sorted((r.doc_id, r.score) for r in out if 5000 <= r.doc_id < 9000)

    one = scores(train + unseen + hot[:1], labels + [(9000, 1)])
    assert scores(train + unseen + hot, labels + [(9000, 1)]) == one
    assert all((s < 0.5) == (i % 2 == 1) for i, s in one)


def test_content_counts_beside_shape(spark):
    """Fluent nonsense: texts and their rot13 have one shape, so only their words can tell them apart."""
    import codecs

    said = lambda i: text("en", 60, i) if i % 2 else codecs.encode(text("en", 60, i), "rot13")
    train = [(i, said(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, label int")
    unseen = [(1000 + i, said(5000 + i)) for i in range(100)]
    out = {r.doc_id: r.score for r in knn.quality_scores(documents(spark, train + unseen), labels).collect()}
    assert sum((out[1000 + i] >= 0.3) == (i % 2 == 1) for i in range(100)) >= 95
    shapes = lambda t: [x[x_at < knn.SHAPES].tolist() for x_at, x in [knn.terms(t.encode())]]
    assert shapes(text("en", 30, 1)) == shapes(codecs.encode(text("en", 30, 1), "rot13"))
