import random

import numpy as np
import pytest

from framelake.llm import leakage as L

W = [f"word{c}{d}" for c in "abcdefgh" for d in "pqrstu"]


def holds(item, units):
    """Brute force: some range of at least the least length within one edit in eight of some part of the text."""
    need, n = L.MIN_UNITS[item.han], len(item.units)
    for p in range(n - need + 1):
        row = [0] * (len(units) + 1)  # fewest edits of item[p:q] to a part that ends here
        for q in range(p, n):
            new = [row[0] + 1]
            for j, u in enumerate(units):
                new.append(min(row[j] + (u != item.units[q]), row[j + 1] + 1, new[j] + 1))
            row = new
            length = q + 1 - p
            if length >= need and 8 * min(row) <= length:
                return True
    return False


@pytest.mark.parametrize("han", [False, True])
def test_passages_equal_brute_force(han):
    rng = random.Random(4 + han)
    alphabet = [chr(0x4E00 + 5 * i) for i in range(60)] if han else W
    items = [L.Item(i, ("" if han else " ").join(rng.choices(alphabet, k=70)), set()) for i in range(3)]
    auto = L.automaton(items)
    found = wrong = 0
    for t in range(150):
        it = items[t % 3]
        size = rng.randrange(14, 50) + 10 * han
        a = rng.randrange(len(it.units) - size)
        part = list(it.units[a : a + size])
        for _ in range(rng.randrange(0, size // 6)):
            j = rng.randrange(len(part))
            part[j : j + rng.randrange(2)] = rng.choice([[], [rng.choice(alphabet)], [part[j], rng.choice(alphabet)]])
        units = rng.choices(alphabet, k=12) + part + rng.choices(alphabet, k=12)
        got = {k for _, k, _, _ in L.find([(0, ("" if han else " ").join(units))], items, auto)}
        want = {i.id for i in items if holds(i, units)}
        found += len(want)
        wrong += got != want
    assert wrong == 0 and 40 < found < 140


def pairs(docs, items):
    read = L.read_items(items)
    return {(d, i) for d, i, _, _ in L.find(docs, read, L.automaton(read))}


def test_words_that_punctuation_joins_or_splits():
    text = "Rank Sr-Ti-O by short-range order, then Pb-free solder at 67.60 units near Na-Cl and Cu(111) before the well-known melt ends at last within 5.25 turns of it."
    plain = "".join(c if c.isalnum() else " " for c in text)
    joined = "".join(c for c in text if c.isalnum() or c == " ")
    assert pairs([(1, "x " + plain + " y"), (2, joined), (3, text), (4, plain.split("melt")[0][:60])], [(7, text)]) == {(1, 7), (2, 7), (3, 7)}


def test_numbers_at_the_head_of_a_line():
    item = " ".join(W[:12]) + " reaches 23. " + " ".join(W[12:24]).capitalize() + "."
    wrapped = "> " + " ".join(W[3:12]) + " reaches\n> 23. " + " ".join(W[12:22]).capitalize()
    listed = "Notes.\n1. " + " ".join(W[2:12]) + " reaches 23.\n2. " + " ".join(W[12:22])
    assert pairs([(1, wrapped), (2, listed)], [(7, item)]) == {(1, 7), (2, 7)}
    assert L.words(wrapped)[9:12] == ["reaches", "23", W[12]] and "1" not in L.words(listed) and "2" not in L.words(listed)


def test_every_passage_and_its_place():
    item = " ".join(W)
    text = "Start. " + " ".join(W[:22]) + " and then something else entirely was written here. " + " ".join(W[24:46]) + " end"
    read = L.read_items([(1, item)])
    got = sorted(L.find([(5, text)], read, L.automaton(read)))
    assert [text[a:b].split()[0] for _, _, a, b in got] == [W[0], W[24]] and [text[a:b].split()[-1] for _, _, a, b in got] == [W[21], W[45]]


def test_long_tags_and_stock_sentences_inside():
    stock = "This stock sentence stands in several items word for word and counts for nothing at all."
    a, b = " ".join(W[:14]) + ".", " ".join(W[14:28]) + "."
    items = [(1, f"{a} {stock} {b}"), (2, " ".join(f"z{w}" for w in W[:30]) + ". " + stock)]
    long_tag = '<a href="' + "u" * 400 + '">'
    docs = [(1, f"{a} {stock} {b}"), (2, stock), (3, " ".join(W[:10]) + long_tag + " " + " ".join(W[10:14]) + f". {stock} {b}"), (4, f"{a} {b}"), (5, None), (6, "   ")]
    assert pairs(docs, items) == {(1, 1), (3, 1), (4, 1)}
    assert pairs(docs, []) == set() and pairs([], items) == set()


def test_least_hits_follow_from_the_lengths():
    assert L.HITS == {True: 8, False: 5}
    starts = L._starts(L.Item(1, " ".join(W), set()), np.arange(3, 19))
    assert 3 in starts and 30 not in starts
