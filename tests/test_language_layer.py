import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from tidings.functions.stems import stem_table
from tidings.operators import languages as L
from tidings.operators import segments as S
from tidings.operators.sentences import learn_abbreviations, split_sentences
from tidings.operators.words import word_counts

# Made texts of four languages.
SAMPLES = {
    "en": "the weather was good and the children went to school with their friends because they wanted to learn",
    "de": "das wetter war schön und die kinder gingen mit ihren freunden in die schule weil sie lernen wollten",
    "fr": "le temps était beau et les enfants sont allés à l'école avec leurs amis parce qu'ils voulaient apprendre",
    "ru": "погода была хорошая и дети пошли в школу со своими друзьями потому что хотели учиться",
}


def test_profiles_tell_languages(spark):
    rows = [(lang, " ".join(random.Random(i).sample(text.split(), 12))) for lang, text in SAMPLES.items() for i in range(5)]
    profiles = L.learn(spark.createDataFrame([*rows, (None, "x y z"), ("en", None), ("", "abc")], "language string, text string"))
    assert profiles.languages == sorted(SAMPLES)
    asked = [("en", "their children wanted friends"), ("de", "ihren freunden und kinder"), ("fr", "les enfants voulaient"), ("ru", "дети хотели"), ("", "abc"), ("", ""), ("", None), ("", "12345 67890 12345"), ("en", "the weather " * 20_000)]
    got = L.identify(spark.createDataFrame(asked, "want string, text string"), profiles).collect()
    assert [r.guess for r in got] == [r.want for r in got]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("lang").alias("language"))
    profiles = L.learn(docs.filter("doc_id % 3 > 0"))
    rows = [r for r in L.identify(docs.filter("doc_id % 3 = 0"), profiles).collect() if len(r.text or "") >= 40]
    for lang in ("en", "de", "fr", "es"):
        own = [r.guess == lang for r in rows if r.language == lang]
        assert len(own) > 10 and sum(own) >= 0.97 * len(own)


def test_best_path_against_all_paths():
    rng = random.Random(3)
    for _ in range(60):
        words = {"".join(rng.choices("天地人大", k=rng.randint(1, 3))): rng.randint(1, 30) for _ in range(8)}
        d = S.dictionary(words)
        run = "".join(rng.choices("天地人大中", k=7))
        best = None
        for cuts in product([0, 1], repeat=6):
            parts, at = [], 0
            for k, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(run[at:k])
                    at = k
            scores = [d.scores.get(p, d.unknown if len(p) == 1 else None) for p in parts]
            if None not in scores:
                best = max(best, sum(scores)) if best is not None else sum(scores)
        got = S.best_path(run, d)
        assert "".join(got) == run and abs(sum(d.scores.get(p, d.unknown) for p in got) - best) < 1e-9
    assert S.best_path("", d) == []


def test_words_are_learnt_from_runs(spark):
    rng, letters = random.Random(8), [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    words = ["".join(rng.sample(letters, n)) for n in [2] * 40 + [3] * 15 + [1] * 10]
    rows, truth = [], []
    for i in range(400):
        own = rng.choices(words, k=rng.randint(5, 15))
        truth.append(own)
        rows.append((i, "".join(own), "zh"))
    df = spark.createDataFrame([*rows, (1000, None, "zh"), (1001, "", "zh"), (1002, "Hello " + words[0] + " iPhone-X", "zh")], "id int, sentence string, language string")
    d = S.learn_words(df, "sentence")
    got = {r.id: r.words for r in S.segmented(df, d, "sentence").collect()}
    right = total = 0
    for i, own in enumerate(truth):
        assert "".join(got[i]) == rows[i][1]
        ends = lambda ws: {sum(map(len, ws[: k + 1])) for k in range(len(ws))}
        right, total = right + len(ends(own) & ends(got[i])), total + len(ends(own) | ends(got[i]))
    assert right >= 0.9 * total
    assert got[1000] is None and got[1001] == [] and got[1002] == ["hello", words[0], "iphone-x"]
    counts = {r.stem: r["count"] for r in word_counts(df, dictionary=d).collect()}
    assert counts[words[0]] == sum(min(3, Counter(got[i])[words[0]]) for i in got if got[i])
    assert S.learn_words(df.limit(0), "sentence").scores == {}


def test_planted_abbreviations_do_not_split(spark):
    rng = random.Random(2)
    plain = "house garden river market window people country morning winter letter road school".split()
    starts = "The He It They".split()

    def sentence():
        own = rng.choices(plain, k=rng.randint(4, 9))
        if rng.random() < 0.5:
            own.insert(2, rng.choice(["approx. 40", "Dr. Miller", "e.g. Paris", "J. Smith", "etc."]))
        return " ".join([rng.choice(starts), *own]) + rng.choice([".", ".", "!", "?"])

    docs = [[sentence() for _ in range(12)] for _ in range(60)]
    rows = [(i, " ".join(d), "en") for i, d in enumerate(docs)] + [(100, None, "en"), (101, "", None), (102, "One line\nAnother line with Dr. Miller\n{}{}{}[]", "en")]
    df = spark.createDataFrame(rows, "id int, text string, language string")
    learnt = learn_abbreviations(df)
    (own,) = [r for r in learnt.collect() if r.language == "en"]
    assert {"approx", "dr", "e.g"} <= set(own.abbreviations) and not set(plain) & set(own.abbreviations)
    got = {r.id: r.sentences for r in split_sentences(df, learnt).collect()}
    assert sum(got[i] == d for i, d in enumerate(docs)) >= 0.95 * len(docs)
    assert got[100] == got[101] == [] and got[102] == ["One line", "Another line with Dr. Miller"]


def test_stemmed_counts(spark):
    rows = [("The runner was running and running and running and running home", "en"), ("Häuser und Haus", "de"), ("Runs the runner", "en"), ("Runs the runner", "en"), ("bare words", None)]
    df = spark.createDataFrame(rows, "sentence string, language string")
    stems = {(r.language, r.word): r.stem for r in stem_table(L.distinct_words(df, "sentence")).collect()}
    assert stems["en", "running"] == "run" and stems["de", "häuser"] == stems["de", "haus"] == "haus" and stems["", "words"] == "words"
    got = {r.stem: (r.term, r["count"]) for r in word_counts(df, stemmed=True).collect()}
    assert got["run"] == ("running", 4) and got["haus"] == ("haus", 2) and got["runner"] == ("runner", 2) and "the" not in got
    pairs = {r.stem for r in word_counts(df, n=2, stemmed=True).collect()}
    assert "run run" in pairs and "run home" in pairs and "runner run" in pairs
