import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidegauge.llm import queries
from tidegauge.llm import subword_sample as ss

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sampler():
    return ss.Sampler(PATH)


def all_paths(sampler, text):
    """{ids: log p} of every segmentation of a short text, by plain recursion."""
    lat = sampler.lattices
    pieces = {sampler.model.id_to_piece(int(i)): (int(i), float(w)) for i, w in zip(lat.ids, lat.weights, strict=True)}
    full = sampler.model.normalize(text)

    def cut(s):
        if not s:
            yield (), 0.0
            return
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                i, w = pieces[s[:n]]
                for ids, log in cut(s[n:]):
                    yield (i, *ids), w + log
        if s[0] not in pieces:
            b = sampler._bytes(s[0])
            for ids, log in cut(s[1:]):
                yield b + ids, ss.BYTE * len(b) + log

    found = dict(cut(full))
    total = math.log(sum(map(math.exp, found.values())))
    return {i: w - total for i, w in found.items()}


@pytest.mark.parametrize("text", ["banana", "ab cd", "\n日x", "é☃"])
def test_without_replacement_and_with_exact_probabilities(sampler, text):
    want, k, runs = all_paths(sampler, text), 3, 800
    first, second = Counter(), Counter()
    for at in range(0, runs, 400):
        for found in sampler.sample_batch([text] * 400, k, list(range(at * 7919, at * 7919 + 400))):
            ids = [tuple(i) for i, *_ in found]
            assert len(set(ids)) == len(ids) == min(k, len(want))
            assert [p for _, p, *_ in found] == pytest.approx([want[i] for i in ids], abs=1e-3)
            assert sorted((g for *_, g, _ in found), reverse=True) == [g for *_, g, _ in found]
            assert all(0 < s <= 1 for *_, s in found)
            first[ids[0]] += 1
            if len(ids) > 1:
                second[ids[:2][0], ids[1]] += 1
    for i, w in want.items():
        assert abs(first[i] / runs - math.exp(w)) < 4 * math.sqrt(math.exp(w) / runs) + 0.006
        for j, v in want.items():
            if i != j:
                p = math.exp(w) * math.exp(v) / -math.expm1(w)
                assert abs(second[i, j] / runs - p) < 4 * math.sqrt(p / runs) + 0.006


def test_the_inclusion_scores_estimate_sums(sampler):
    text, runs = "banana", 500
    want = all_paths(sampler, text)
    exact = sum(math.exp(w) * len(i) for i, w in want.items())
    got = np.mean([sum(math.exp(p) / q * len(i) for i, p, _, q in f) for f in sampler.sample_batch([text] * runs, 4, list(range(runs)))])
    assert abs(got - exact) < 0.4


def test_a_dominant_cut_leaves_the_rest_reachable(sampler):
    want = all_paths(sampler, "a")
    found = sampler.sample_batch(["a"], 9, [1])[0]
    assert {tuple(i) for i, *_ in found} == set(want)


@pytest.mark.parametrize("text", ["to", "the", "ooooo", "international", "no one"])
def test_asked_for_all_paths_gives_each_once(sampler, text):
    want = all_paths(sampler, text)
    found = sampler.sample_batch([text], len(want) + 3, [3])[0]
    ids = [tuple(i.tolist()) for i, *_ in found]
    assert len(ids) == len(set(ids)) == len(want) and set(ids) == set(want)
    assert all(abs(p - want[i]) < 1e-6 for i, (_, p, *_) in zip(ids, found, strict=True))
    assert {q for *_, q in found} == {1.0}


def test_what_is_left_of_a_word_is_exact(sampler):
    """Against sums over all cuts, also where one minus the share has no digits."""
    sampler.sample_batch(["internal"], 1, [1])
    [word] = sampler.units("internal")
    row, table = sampler.lattices.at[word], sampler.lattices
    want = all_paths(sampler, "internal")
    log, own, place, column = table.walk(np.array([row]), np.array([row + len(word)]), np.array([5], np.uint64), 0)
    ids = tuple(table.piece[place, column].tolist())
    rest = math.log(sum(math.exp(w) for i, w in want.items() if i != ids))
    assert table.others(log, own, place, column)[0] == pytest.approx(rest, abs=1e-6)
    trie, kept = ss.Out(), dict(want)
    for at in range(40):
        cut = table.draw_left(trie, row, row + len(word), [((at * 37 + c * 11) % 101 + 0.5) / 102 for c in range(len(word))])
        spots = row + np.cumsum([0, *(c + 1 for c in cut[:-1])])
        del kept[tuple(table.piece[spots, list(cut)].tolist())]
        table.exclude(trie, row, row + len(word), cut)
        assert trie.left == pytest.approx(math.log(sum(map(math.exp, kept.values()))), abs=1e-6)


def test_ties_and_equal_rows_draw_alike(sampler):
    a, b = sampler.sample_batch(["tie tie", "tie tie"], 4, [9, 9])
    assert [(tuple(i), p, g, q) for i, p, g, q in a] == [(tuple(i), p, g, q) for i, p, g, q in b]


def test_query_rows_against_plain_encoding(spark, sampler):
    """Every row of the registered query: pieces that spell the text, the log share of the cut by recursion over its words, distinct draws."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op5_subword_sample(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.round_trip for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    lat, mass = sampler.lattices, {}
    weights = dict(zip(lat.ids.tolist(), lat.weights.tolist(), strict=True))
    pieces = {sampler.model.id_to_piece(i): w for i, w in weights.items()}
    for i, found in by.items():
        assert len({tuple(r.ids) for r in found}) == len(found) and [r.draw for r in found] == list(range(1, len(found) + 1))
        total = 0.0
        for word in sampler.units(texts[i]):
            if word not in mass:
                below = [0.0] * (len(word) + 1)
                for a in range(len(word) - 1, -1, -1):
                    logs = [pieces[word[a:b]] + below[b] for b in range(a + 1, min(len(word), a + lat.width) + 1) if word[a:b] in pieces]
                    if word[a] not in pieces:
                        logs.append(ss.BYTE * len(sampler._bytes(word[a])) + below[a + 1])
                    below[a] = max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))
                mass[word] = below[0]
            total += mass[word]
        for r in found:
            assert r.log_p == pytest.approx(sum(weights.get(x, ss.BYTE) for x in r.ids) - total, abs=1e-6 * max(1, abs(total)))


def test_queries_edge_cases(spark):
    rows = [(1, "plain words"), (2, None), (3, ""), (None, "no key"), (4, "dup"), (4, "dup"), (5, "long " * 20_000), (6, "ünï ☃ \x00 \t tabs\r\n"), (7, "  two  spaces ")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = ss.sample_segmentations(df, PATH, 2).collect()
    assert all(r.round_trip for r in got)
    assert Counter(r.doc_id for r in got)[2] == 1 and Counter(r.doc_id for r in got)[4] == 4
    assert ss.sample_segmentations(df.where("false"), PATH).collect() == []
    again = ss.sample_segmentations(df.repartition(5), PATH, 2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_words_that_come_again_are_remembered_and_draws_do_not_depend_on_it(sampler, monkeypatch):
    """Before, a full table forgot every word, so the same words were made over and over."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 8))
    often = [word() for _ in range(20)]
    batches = [[" ".join([*often, *(word() for _ in range(40))])] for _ in range(12)]
    draw = lambda b: [(ids.tolist(), *rest) for ids, *rest in sampler.sample_batch(b, 3, [7])[0]]
    want = []
    for b in batches:
        sampler.lattices.reset()
        want.append(draw(b))
    made, add = [], sampler.lattices.add
    monkeypatch.setattr(ss, "REMEMBERED", 1200)
    monkeypatch.setattr(sampler.lattices, "add", lambda words: made.extend(words) or add(words))
    sampler.lattices.reset()
    got = [draw(b) for b in batches]
    assert got == want
    assert len(made) == len(set(made)) and sampler.lattices.rows <= 1200
    sampler.lattices.reset()


def test_a_remembered_character_takes_little_room(sampler):
    """Before, each character had a row as wide as the longest piece, 320 bytes, though two pieces start there on average."""
    table = sampler.lattices
    table.reset()
    sampler.sample_batch(["international segmentations of quite ordinary words, drawn twice"], 2, [1])
    bytes_of = lambda names: sum(np.dtype(kind).itemsize for _, kind in names)
    assert table.rows > 50 and table.rows * bytes_of(table.BY_ROW) + table.options * bytes_of(table.BY_OPTION) < 100 * table.rows
    assert table.options == table.count[: table.rows].sum()


ODD = ["a b  c", "", "   ", "x▁▁y ▁", "tie2tie_tie²", "日本語text ☃☃ é", "tail  ", "a" * 300 + " b1", "\x00\t\n"]


@pytest.mark.parametrize("alike", [False, True])
def test_words_of_a_batch_are_the_regular_expression_s_and_looked_up_once(sampler, monkeypatch, alike):
    """Before, every word of every text was made a string and looked up. Also where hashes can't tell words apart."""
    texts, asked, place = [*map(sampler.normal, ODD), *map(sampler.normal, ODD)], [], sampler.lattices.place
    monkeypatch.setattr(sampler.lattices, "place", lambda words: asked.extend(words) or place(words))
    if alike:
        monkeypatch.setattr(sampler, "powers", np.zeros(1000, np.uint64))
    for cut in (ss._RUNS, ss._WORDS):
        asked.clear()
        monkeypatch.setattr(sampler, "cut", cut)
        monkeypatch.setattr(sampler, "kinds", np.zeros(0x110000, np.uint8))
        sampler.lattices.reset()
        row, end, stops = sampler._words(texts)
        names = {(at, at + len(w)): w for w, at in sampler.lattices.at.items()}
        got = [[names[x] for x in zip(row[a:b].tolist(), end[a:b].tolist(), strict=True)] for a, b in zip(stops, stops[1:], strict=False)]
        assert got == [cut.findall(t) for t in texts]
        assert len(asked) == len(set(asked))
    sampler.lattices.reset()
