import pytest

from semaspark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def restorer(spark):
    return toxicity.Restorer(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


@pytest.mark.parametrize("said,meant", [("1d10t", "idiot"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("l.o.s.e.r", "loser"), ("$cum", "scum"), ("tr@sh", "trash"),
                                        ("p4th3tic", "pathetic"), ("id!ot", "idiot"), ("idiooot!", "idiot"), ("The,", "the"), ("123", "123"), ("", ""), ("...", "")])
def test_restored(restorer, said, meant):
    assert restorer.restore(said) == meant


def test_spaced_words(restorer):
    part = next(toxicity.chunks(toxicity.pa.array(["you i d i o t there", "a b"])))
    words, which, row = restorer.words(part)
    assert "idiot" in words and row[which == words.index("idiot")].tolist() == [0]


@pytest.mark.parametrize("said,meant", [("stuupid", "stupid"), ("idioot", "idiot"), ("shi+", "shit"), ("as$", "ass"), ("idio+", "idiot"), ("idiot$$$", "idiot"), ("word###", "word"),
                                        ("idiot!", "idiot"), ("st" + "u" * 80 + "pid", "stupid"), ("idiot,moron", "idiot"), ("lose", "lose"), ("l_o_s_e_r", "loser")])
def test_signs_doubles_and_long_words(restorer, said, meant):
    assert meant in restorer.features(said) and meant in restorer.readings(said)


@pytest.mark.parametrize("phrase", ["y o u s t u p i d i d i o t", "you s t u p i d i d i o t " + "x y " * 40, "you stu pid man and idi ot", "y.o.u.s.t.u.p.i.d.i.d.i.o.t",
                                    "y.o.u.s.t.u.p.i.d.i.d.i.o.t." + "x.y." * 40])
def test_every_word_of_a_phrase(restorer, phrase):
    part = next(toxicity.chunks(toxicity.pa.array([phrase])))
    found = {f for w in restorer.words(part)[0] for f in restorer.features(w)}
    assert "stup~" in found and "idio~" in found


@pytest.mark.parametrize("word", ["stuupid", "goodleetter", "ooaa", "ab", "aabbcc", "éélan"])
def test_doubles_are_decided_as_in_the_lattice(restorer, word):
    assert restorer.restore(word) == restorer._decode(word, frozenset())


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    log_p = toxicity.character_model(docs)
    wanted, weights = toxicity.fit(docs, labels.where(toxicity.remainder("doc_id", 5) != 0), log_p)
    rows = docs.join(labels, "doc_id").where(toxicity.remainder("doc_id", 5) == 0).select("toxic", toxicity.score(docs, log_p, wanted, weights).alias("s")).collect()
    hit = sum(r["s"] >= 0.5 for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    false = sum(r["s"] >= 0.5 for r in rows if not r["toxic"]) / sum(not r["toxic"] for r in rows)
    assert hit > 0.8 and false < 0.02


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)] + [(None, 1, 1), (3, 1, None)], LABELS)
    log_p = toxicity.character_model(odd)
    wanted, weights = toxicity.fit(odd, labels, log_p)
    scores = [r[0] for r in odd.select(toxicity.score(odd, log_p, wanted, weights)).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    log_p = toxicity.character_model(empty)
    wanted, weights = toxicity.fit(empty, labels, log_p)
    assert empty.select(toxicity.score(empty, log_p, wanted, weights)).count() == 0


def test_plain_words_are_found_by_hash(restorer, monkeypatch):
    texts = ["The Cat, (sat) on: 'été' a Straße. ÉLAN x", "stuupid l.o.s.e.r 1d10t coffee! b a d a$$ İ ⅷ", "", None, "The"]
    part = next(toxicity.chunks(toxicity.pa.array(texts)))
    words, which, row = restorer.words(part)
    slow = {(r, f) for r, w in zip(row.tolist(), which.tolist()) for f in restorer.features(words[w])}
    assert set(zip(*(list(x) for x in toxicity._row_features(restorer, part, None)))) == slow
    names = {f: i for i, f in enumerate(sorted({f for _, f in slow}))}
    rows, features = toxicity._row_features(restorer, part, toxicity.Wanted.of(names))
    assert sorted(zip(rows.tolist(), features.tolist())) == sorted((r, names[f]) for r, f in slow)
    asked = []
    monkeypatch.setattr(restorer, "features", lambda w: asked.append(w) or ())
    monkeypatch.setattr(restorer, "_ends", lambda w: asked.append(w) or (0, 0, 0, 0))
    toxicity._row_features(restorer, next(toxicity.chunks(toxicity.pa.array(["The", "Cat,", "[sat]", "Straße.", "ÉLAN", "a"]))), toxicity.Wanted.of(names))
    assert asked == []


def test_doubled_and_joined_words_are_found_by_hash(restorer, monkeypatch):
    texts = ["Stuupid bookkeeper, ÉÉLAN [aabb] succeess ooaa aaa", "you stu pid idi ot man and gooood letteer ab l.o.s.e.r d.o", "the of in to a b", "", "$cum 1d10t shi+ x 12 É"]
    part = next(toxicity.chunks(toxicity.pa.array(texts)))
    words, which, row = restorer.words(part)
    slow = {(r, f) for r, w in zip(row.tolist(), which.tolist()) for f in restorer.features(words[w])}
    names = {f: i for i, f in enumerate(sorted({f for _, f in slow}))}
    rows, features = toxicity._row_features(restorer, part, toxicity.Wanted.of(names))
    assert sorted(zip(rows.tolist(), features.tolist())) == sorted((r, names[f]) for r, f in slow)
    asked = []
    monkeypatch.setattr(restorer, "features", lambda w: asked.append(w) or ())
    toxicity._row_features(restorer, part, toxicity.Wanted.of(names))
    assert asked and all(not w.isalpha() or toxicity._THRICE.search(w) for w in asked) and not {"x", "12", "é", "ab"} & set(asked)


@pytest.mark.parametrize("word", ["don't", "stu.pid", "idiot,moron", "b00kk33per", "aaab", "l.o.s.e.r", "2019th", "x-ray-and-more", "ééa.b"])
def test_stretches_of_letters_are_decoded_like_single_runs(restorer, monkeypatch, word):
    fast = restorer._decode(word, frozenset())
    monkeypatch.setattr(toxicity, "_PIECES", toxicity.re.compile(r"()?(.)\2*", toxicity.re.S))
    assert restorer._decode(word, frozenset()) == fast
