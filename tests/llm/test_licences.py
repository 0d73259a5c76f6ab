import random

from pyspark.sql import functions as F

from loomtrace.llm import licences
from loomtrace.llm.common import words_of


def base(text):
    words, places, labels = [w.decode() for w in words_of((text or "").encode())], [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_is_exact(spark):
    r = random.Random(2)
    bits = ["cc", "by", "CC-BY", "general", "public license", "General Public License", "all rights", "reserved", "x", "é", "all rights reserved.", "the"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.choice([0, 2, 5, 60])))) for i in range(150)]
    rows += [(1, rows[1][1]), (1, "cc by other"), (200, None), (None, "cc by"), (201, "cc by " * 30_000), (202, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("template", F.lit(0)).repartition(3)
    got = sorted(((x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in licences.scan(df).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert licences.scan(df.limit(0)).count() == 0


def test_texts_with_changes_are_found_and_merged(spark):
    mit = licences.NOTICES["mit"].split()
    changed = mit[:12] + ["brand", "new"] + mit[12:20] + mit[22:]
    rows = [(1, " ".join(["intro"] * 7 + changed)), (2, " ".join(mit[:6])), (3, " ".join(reversed(mit))), (4, licences.NOTICES["gpl-notice"].upper()), (5, "of the software and associated things")]
    got = {x["doc_id"]: x for x in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1]["labels"] == "mit" and 0.6 <= got[1]["score"] < 1 and len(got[1]["found"]) == 1
    assert got[1]["found"][0]["first"] == 7
    assert got[2]["labels"] == got[3]["labels"] == got[5]["labels"] == "" and got[2]["score"] == 0
    assert got[4]["labels"] == "gpl,gpl-notice" and got[4]["score"] == 1 and got[4]["base_labels"] == "gpl"


def common(a, b):
    """Longest common subsequence by the textbook's table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def brute(text, slack=8, coverage=0.6):
    """(labels, score, spans) of a text, by comparing every place of it to every place of every template."""
    words, found = words_of((text or "").encode()), []
    for t in licences.templates():
        k, last = t.k, len(t.words) - t.k
        diagonals = {}
        for p in range(len(words) - k + 1):
            for q in range(last + 1):
                if tuple(words[p : p + k]) == t.words[q : q + k]:
                    diagonals.setdefault(p - q, []).append((p, q))
        groups = []
        for d in sorted(diagonals):
            if groups and not t.exact and d - groups[-1][0] <= slack:
                groups[-1] = (d, groups[-1][1] + diagonals[d])
            else:
                groups.append((d, list(diagonals[d])))
        for _, hits in groups:
            share = len({q for _, q in hits}) / (last + 1)
            lo, hi = min(p for p, _ in hits), max(p for p, _ in hits) + k
            if share < (1 if t.exact else coverage):
                continue
            share = common(words[lo:hi], t.words) / len(t.words)
            if share >= (1 if t.exact else coverage):
                found.append((lo, hi - 1, t.label, share))
    return ",".join(sorted({x[2] for x in found})), max((x[3] for x in found), default=0.0), sorted(found)


def test_labels_scores_and_spans_same_as_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(120):
        words = [r.choice("the of software license is a permission copy to any x y".split()) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            own = r.choice([*licences.NOTICES.values(), *licences.PHRASES]).split()
            for _ in range(r.choice([0, 0, 1, 3, 10])):
                j = r.randrange(len(own))
                own = r.choice([own[:j] + own[j + 1 :], own[:j] + ["new"] + own[j:], own[:j] + own[j + 2 :] + own[j : j + 2]]) or ["x"]
            at = r.randint(0, len(words))
            words[at:at] = own * r.choice([1, 1, 1, 2])
        rows.append((i, r.choice([" ", ", ", "\n"]).join(w.upper() if r.random() < 0.2 else w for w in words)))
    rows += [(200, None), (201, "")]
    got = {x["doc_id"]: (x["labels"], x["score"], sorted(map(tuple, x["found"] or ()))) for x in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert sum(bool(x[0]) for x in got.values()) > 60 and any(0.6 <= x[1] < 1 for x in got.values())


def test_every_gram_is_joined(spark, monkeypatch):
    """Grams whose hashes clash with a template's meet it in the join, and the words tell them apart."""
    monkeypatch.setattr(licences, "_rolled", lambda h, k: licences.np.full(max(0, len(h) - k + 1), k, licences.np.uint64))
    rows = [(1, "some words that are no licence at all"), (2, "x all rights reserved y"), (3, "cc"), (4, "released under the mit license")]
    got = {x["doc_id"]: (x["n_base"], x["labels"]) for x in licences.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), notices={"mit-license": licences.NOTICES["mit-license"]}).collect()}
    assert got == {1: (0, ""), 2: (1, "reserved"), 3: (0, ""), 4: (0, "mit-license")}


def test_joined_by_shuffle_too(spark, monkeypatch):
    rows = [(i, "all rights reserved " * (i % 3)) for i in range(20)] + [(None, "cc by")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(str, licences.scan(df).collect()))
    monkeypatch.setattr(licences, "BROADCAST_ROWS", 3)
    assert sorted(map(str, licences.scan(df).collect())) == want
