import random
import re
from collections import defaultdict

from rankwell.llm.license_scan import BASE, NOTICES, WORD, query, scan_licenses

DOCS = "doc_id long, text string, n_words long, gram int"


def words_of(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    words, found = words_of(text), []
    for phrase, label in BASE:
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], DOCS)


def test_base_places_against_brute_force(spark):
    dice = random.Random(3)
    parts = "gnu general public license apache License cc BY mit é 2.0 cc-by MIT/license".split()
    texts = [" ".join(dice.choice(parts) for _ in range(dice.randrange(40))) for _ in range(150)]
    texts += [None, "", "license", "\n\t", "apache_license cc by-sa", "Mit\x00License", "apache license " * 9000]
    for row in query(frame(spark, texts)).collect():
        n, found = brute_base(texts[row.doc_id])
        assert (row.n_words, row.n_base) == (n, len(found)), texts[row.doc_id]
        assert (row.first_word, row.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert row.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score == 1.0 or not found)


def test_notice_with_changes_is_found_whole(spark):
    text, label = NOTICES[0]
    words = text.split()
    changed = words[:9] + ["really"] + words[9:20] + words[21:27] + ["xx"] + words[28:]
    (row,) = scan_licenses(frame(spark, ["before it " + " ".join(changed).title() + " after"])).collect()
    (span,) = [s for s in row.spans if s.label == label]
    assert (span.start, span.end, span.base) == (2, 2 + len(changed), False) and 0.8 <= span.coverage < 1
    assert {s.label for s in row.spans} >= {"apache", "apache-notice"}


def brute_notices(text, slack=3, least=0.8):
    """Per notice, places of its word pairs by diagonal; runs of diagonals with no gap above ``slack`` are one span."""
    words, found = words_of(text), []
    places = defaultdict(list)
    for place, pair in enumerate(zip(words, words[1:])):
        places[pair].append(place)
    for notice, label in NOTICES:
        parts = notice.split()
        hits = sorted((place - t, place, t) for t, pair in enumerate(zip(parts, parts[1:])) for place in places[pair])
        runs = []
        for hit in hits:
            if not runs or hit[0] - runs[-1][-1][0] > slack:
                runs.append([])
            runs[-1].append(hit)
        for run in runs:
            coverage = len({t for _, _, t in run}) / (len(parts) - 1)
            if coverage >= least:
                found.append((min(p for _, p, _ in run), max(p for _, p, _ in run) + 2, label, coverage))
    return sorted(found)


def changed_notices(dice):
    """Notices one after another, words of them left out, put in or replaced, with filler between."""
    out = []
    for _ in range(dice.randrange(1, 5)):
        out += ["filler"] * dice.randrange(6)
        for word in dice.choice(NOTICES)[0].split():
            kind = dice.random()
            out += [word] if kind > 0.06 else [] if kind < 0.02 else ["new", word] if kind < 0.04 else ["other"]
    return " ".join(out)


def test_notices_against_brute_force(spark):
    dice = random.Random(11)
    texts = [changed_notices(dice) for _ in range(200)]
    texts += [None, "", " ".join(NOTICES[1][0].split() * 400), " ".join(n for n, _ in NOTICES), NOTICES[4][0] + " " + NOTICES[4][0]]
    got = {
        row.doc_id: sorted((s.start, s.end, s.label, round(s.coverage, 9)) for s in row.spans if not s.base)
        for row in scan_licenses(frame(spark, texts)).collect()
    }
    want = {i: [(*span[:3], round(span[3], 9)) for span in brute_notices(text)] for i, text in enumerate(texts)}
    assert got == want
    assert 50 < sum(map(len, want.values()))


def test_far_pieces_are_no_notice(spark):
    words = NOTICES[1][0].split()
    scattered = " ".join(words[:12]) + " filler" * 50 + " " + " ".join(words[12:])
    (row,) = scan_licenses(frame(spark, [scattered])).collect()
    assert not row.spans


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "MIT license", 0, 0)] * 3 + [(1, "other", 0, 0)], DOCS)
    assert sorted(r.n_base for r in query(docs).collect()) == [0, 1, 1, 1]
    assert query(spark.createDataFrame([], DOCS)).count() == 0
