import random
from collections import Counter

import pytest

from strake.llm.leaks import Passages, find_leaks, words_of
from strake.llm.packing import best_fit_decreasing, pack, pack_sizes
from strake.llm.reading import fit_levels, language, read, reading_levels, syllables

from .one_by_one import aligned, reproduced

PASSAGE = (
    "Read the text and pick the best answer. The patient ferry of Orlunosk crossed a silent river before the northern miller "
    "opened every wooden gate. Another curious sailor described the lantern beside the ancient tower, while the gentle falcon "
    "carried one copper compass toward the frozen harbour of Tanvelrith, because no bridge had survived the winter storm."
)
WORDS = PASSAGE.split()


def brute_bfd(sizes, cap):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [k for k, r in enumerate(bins) if r >= s]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= s
        else:
            bins.append(cap - s)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(25))
def test_packing_equals_one_by_one_best_fit(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 37, 100])
    sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 300))]
    runs, n = best_fit_decreasing(dict(Counter(sizes)), cap)
    room = [cap] * n
    for size, _, items, each, first in runs:
        for j in range(items):
            room[first + j // each] -= size
    assert sorted(room) == brute_bfd(sizes, cap)


def test_pack_sizes_round_trip(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 1, 7, 7, 7, 50, 99, 100, 101, 250, 300])) for i in range(500)] + [(7, 7), (None, 30)]
    got = pack_sizes(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 100, block_rows=20).collect()
    used = Counter()
    for r in got:
        used[r.container_id] += r.tokens
        assert r.start_token == r.piece * 100
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert sum(used.values()) == sum(n for _, n in rows)
    whole = Counter(r.doc_id for r in got)
    assert all(whole[d] == -(-n // 100) for d, n in rows if d not in (7, None) and n)
    rest = [n % 100 for _, n in rows if n % 100]
    assert len(used) == len(brute_bfd(rest, 100)) + sum(n // 100 for _, n in rows)


def test_pack_nulls_empty_and_special_strings(spark):
    docs = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x"), (5, "word " * 3000, "x")], "doc_id long, text string, size string")
    got = pack(docs).collect()
    assert {r.doc_id for r in got} == {1, 4, 5} and [r.tokens for r in got if r.doc_id == 4][0] > 1
    assert sorted(r.tokens for r in got if r.doc_id == 5)[-1] == 2048
    assert pack(docs.limit(0)).count() == 0


def damage(words, seed):
    rnd = random.Random(seed)
    out = []
    for w in words:
        if rnd.random() < 0.2 and len(w) > 4:
            k = rnd.randrange(1, len(w) - 1)
            w = w[:k] + w[k + 1 :]
        out.append(w.upper() if rnd.random() < 0.3 else w)
    return out


def shares(text):
    return {i: s for _, i, s in Passages([(1, PASSAGE)], 0.0).search([text])}


def test_leaks_found_whatever_was_done_to_the_text():
    filler = "This kettle works well and my aunt likes the colour of it. "
    assert shares(filler + PASSAGE + filler)[1] == 1.0
    assert shares(filler + " ".join(damage(WORDS, 1)) + filler)[1] > 0.8
    assert shares("".join(WORDS))[1] == 1.0
    assert shares("<p>" + "<br/>\n\t".join(WORDS) + "&nbsp;</p>")[1] == 1.0
    half = WORDS[8:20] + filler.split() + WORDS[30:45]
    assert shares(" ".join(half))[1] == pytest.approx(27 / len(WORDS), abs=0.04)


def test_leaks_not_found():
    filler = "This kettle works well and my aunt likes the colour of it. "
    assert shares(filler * 5) == {}
    assert shares(filler + " ".join(WORDS[:8]) + filler).get(1, 0) < 0.4
    assert shares(" ".join(WORDS[20:32])).get(1, 0) < 0.4
    for seed in range(5):
        assert shares(" ".join(random.Random(seed).sample(WORDS, len(WORDS)))).get(1, 0) < 0.2


def test_leak_table(spark):
    items = spark.createDataFrame([(1, PASSAGE, "a"), (2, "short", "a"), (3, None, "b"), (1, PASSAGE, "a")], "item_id long, passage string, text string")
    docs = spark.createDataFrame([(1, PASSAGE, 0.5), (1, PASSAGE, 0.5), (2, None, 0.1), (3, "", 0.2), (4, "x" * 100_000, 0.3), (5, "blah " * 9000 + PASSAGE + " blah" * 9000, 0.1), (None, PASSAGE, 0.1)], "doc_id long, text string, share double")
    got = find_leaks(docs, items).collect()
    assert sorted((r.item_id, r.doc_id, r.share) for r in got) == [(1, 1, 1.0), (1, 5, 1.0)]
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0
    many = items.union(spark.createDataFrame([(10 + k, PASSAGE[40 * k :], "c") for k in range(4)], items.schema))
    one, blocks = (sorted(map(tuple, find_leaks(docs, many, block_chars=n).collect())) for n in (10**6, 400))
    assert one == blocks and {r[0] for r in one} == {1, 10, 11, 12, 13}


def test_short_passages_count_as_whole_runs_of_words():
    index = Passages([(1, PASSAGE), (2, "Blue moon!"), (3, "one extraordinarily uncharacteristic misunderstanding"), (4, "")], 0.4)
    texts = ["a BLUE, moon rose", "a blue and a moon", "a bluemoon", "One <b>extraordinarily</b> uncharacteristic misunderstanding arose", "", "moon blue"]
    assert [(k, i) for k, i, _ in index.search(texts)] == [(0, 2), (3, 3)]


@pytest.mark.parametrize("window", [1 << 13, 300])
def test_first_count_loses_nothing(monkeypatch, window):
    """Against a search in which every pair of text and passage goes on to the regions, texts in one piece and in several."""
    import pyarrow.parquet as pq

    from strake.llm import leaks

    monkeypatch.setattr(leaks, "WINDOW", window)
    d = "/root/testdata/sf0.01"
    items = list(zip(*(pq.read_table(f"{d}/eval_items.parquet").column(c).to_pylist() for c in ("item_id", "passage"))))
    texts = [t for t in pq.read_table(f"{d}/documents.parquet").column("text").to_pylist() if t]
    index, every = Passages(items, 0.4), Passages(items, 0.4)
    every.sieve = False
    got, want = list(index.search(texts)), list(every.search(texts))
    assert sorted(got) == sorted(want) and len(got) > 10


def test_batched_verification_equals_one_by_one():
    """Every candidate's share, also of those that fall short, against the plain form."""
    import numpy as np
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    items = list(zip(*(pq.read_table(f"{d}/eval_items.parquet").column(c).to_pylist() for c in ("item_id", "passage"))))
    texts = [t for t in pq.read_table(f"{d}/documents.parquet").column("text").to_pylist() if t]
    index, seen = Passages(items, 0.4), []
    shares = index.verify.shares

    def checked(item, cand, pos, at, text, lo, hi, least):
        got, short = shares(item, cand, pos, at, text, lo, hi, 0.0), shares(item, cand, pos, at, text, lo, hi, least)
        for c in range(len(item)):
            mine = cand == c
            want = reproduced(index.items[item[c]], text[lo[c] : hi[c]], pos[mine], at[mine] - lo[c], 0.0)
            assert abs(want - got[c]) < 1e-12 and (abs(short[c] - want) < 1e-12 if want >= least else short[c] < least)
            seen.append(want)
        return short

    index.verify.shares = checked
    assert len(list(index.search(texts))) == np.sum(np.array(seen) >= 0.4) > 10 and len(seen) > 300


def test_planted_passages_are_found():
    """Recall over passages planted in part or whole, in one piece or two, with edits of every kind."""
    import pyarrow.parquet as pq

    d = "/root/testdata/sf0.01"
    items = list(zip(*(pq.read_table(f"{d}/eval_items.parquet").column(c).to_pylist() for c in ("item_id", "passage"))))
    fill = [t for t in pq.read_table(f"{d}/documents.parquet").column("text").to_pylist() if t and len(t) > 200][:100]
    rnd, texts, planted = random.Random(4), [], set()
    for n in range(400):
        i, passage = rnd.choice(items)
        w = passage.split()
        size = int(len(w) * rnd.uniform(0.5, 1.0))
        at = rnd.randrange(len(w) - size + 1)
        piece = damage([x.translate({ord(c): None for c in ".,;"}) if rnd.random() < 0.3 else x for x in w[at : at + size]], n)
        half = len(piece) // 2 if n % 2 else len(piece)
        texts.append(" ".join([rnd.choice(fill), *piece[:half], *("Then again, my neighbour disagreed.".split() if n % 2 else []), *piece[half:], rnd.choice(fill)]))
        planted.add((n, i))
    got = {(k, i) for k, i, _ in Passages(items, 0.4).search(texts)}
    assert len(got & planted) / len(planted) > 0.97, len(got & planted) / len(planted)


def test_alignment_and_folding():
    import numpy as np

    a, b = (np.frombuffer(x.encode(), dtype=np.uint8) for x in ("kitten", "sitting"))
    assert sorted(aligned(a, b)) == [1, 2, 3, 5]
    assert words_of("Un vélo &amp; <b>clÃ©</b>!") == ["un", "velo", "cle"]


EASY = "The cat is red. We got a mat. It was nice for my dog. He took the cup and we ran. "
HARD = "Notwithstanding considerable methodological inconsistency, prolonged observation demonstrates the structural susceptibility of comparable implementations, thereby necessitating comprehensive recalibration. "


def test_syllables_and_language():
    assert [syllables(w, "en") for w in ("made", "table", "observation", "the")] == [1, 2, 4, 1]
    assert syllables("freundlichkeit", "de") == 3 and syllables("maison", "fr") == 2
    assert language(Counter("das ist nicht mein tisch und er ist rot".split())) == "de"


def test_no_prose():
    assert read("aaaa " * 200) is None and read("12345 678 " * 90) is None and read("x" * 500) is None and read("") is None
    r = read(HARD * 3)
    assert r.grades["kincaid"] > read(EASY * 3).grades["kincaid"] + 8


def test_levels(spark):
    rnd = random.Random(0)
    rows = [(i, (EASY if i % 2 else HARD) * rnd.randint(4, 8)) for i in range(60)]
    docs = spark.createDataFrame(rows + [(100, None), (101, ""), (102, "7 " * 300), (103, HARD * 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r1", 1 if i % 2 else 5) for i in range(40)] + [(3, "r2", 9), (4, "r2", None), (None, "r1", 3)], "doc_id long, rater string, grade int")
    got = {r.doc_id: r.level for r in reading_levels(docs, fit_levels(docs, labels)).collect()}
    assert all((got[i] > 3.5) == (i % 2 == 0) for i in range(40, 60))
    assert got[100] is None and got[101] is None and got[102] is None and got[103] > 3.5
    assert fit_levels(docs, labels.limit(0)) is None
    assert {r.level for r in reading_levels(docs, None).collect()} == {None}


def test_held_out_accuracy(spark):
    """Half of the graded documents of sf0.1 against levels fitted to the other half; graders differ by a grade at times."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/grade_labels.parquet")
    levels = fit_levels(docs, labels.where("pmod(hash(doc_id), 2) = 0"))
    truth = labels.where("grade between 1 and 5 and pmod(hash(doc_id), 2) = 1").groupBy("doc_id").agg(F.avg("grade").alias("g"))
    got = reading_levels(docs.where("n_chars >= 300").join(truth, "doc_id"), levels).join(truth, "doc_id")
    r = got.agg(F.count_if(F.expr("level >= 3.5 and g >= 3.5")).alias("tp"), F.count_if(F.expr("level >= 3.5")).alias("p"), F.count_if(F.expr("g >= 3.5")).alias("t")).first()
    assert r.tp / r.p > 0.95 and r.tp / r.t > 0.88
