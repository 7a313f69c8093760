"""Parts of the operators against plain versions of themselves."""

import random
from collections import defaultdict

import numpy as np
import pytest

from samplelake.llm import binary, bwt, decontam, licenses, packing, phrases, repeats, shards
from samplelake.llm.tokens import Encoder, default_path


def test_encoder_gives_the_ids_of_the_library():
    encoder, draw = Encoder(default_path()), random.Random(5)
    signs = list("abcdeA'  \n\t.,!?12_-é²½αß× 　\u0085中́'s't\r") + [
        "'s", "'ll", "don't", "  ", "\n\n", "\n ", "<|endoftext|>", "\x1c", "µ", "…", "🙂", "ﬁ", " foo", "123 ",
    ]
    for _ in range(5000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(1, 14)))
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == [*ids, 0]
    assert np.frombuffer(encoder.encode(None), encoder.type).tolist() == [0]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr("samplelake.llm.tokens.KEPT_WORDS", 8)
    encoder = Encoder(default_path())
    for text in ("one two three four five six", "six seven eight nine ten", "one six ten"):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == [*ids, 0]
    assert len(encoder.known.keys) <= 8 and len(encoder.known.start) <= 8


@pytest.mark.parametrize("together", [1, 40, 1 << 19])
def test_many_texts_at_once(monkeypatch, together):
    monkeypatch.setattr("samplelake.llm.tokens.TOGETHER", together)
    monkeypatch.setattr("samplelake.llm.tokens.KEPT_WORDS", 60)
    monkeypatch.setattr("samplelake.llm.tokens.KEPT_PIECES", 20)
    encoder, draw = Encoder(default_path()), random.Random(6)
    parts = [" the", "it's", "a", " \0", "\0", "Ünal", " 12", ".", "\n", " ", "中", "x" * 30, "'", "\udc80", " of"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    texts = [t.replace("\udc80", "") for t in texts] + [None, "", " ", "a" * 300, "\0"]
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode_many(texts)] == want
    assert [np.frombuffer(encoder.encode(t), encoder.type).tolist() for t in texts] == want


def test_words_with_one_hash(monkeypatch):
    """Where the first hashes of two words are the same, the second tells them apart."""
    from samplelake.llm import tokens

    real = tokens._hashes
    monkeypatch.setattr(tokens, "_hashes", lambda p, a, b, base: real(p, a, b, base) % 5 if base == tokens._BASES[0] else real(p, a, b, base))
    encoder = Encoder(default_path())
    for word in ["one", "two", "three", "four", "five", "six", "one", "two"] * 2 + ["one two three four five six seven eight nine ten"]:
        ids = encoder.tokenizer.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(word), encoder.type).tolist() == [*ids, 0]


def test_frames():
    payload = b"abc\n" * 5
    record = binary.frame(payload) + binary.END_MARK
    assert binary.read_frame(record, 0) == (payload, len(record))
    for at in range(len(record)):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            binary.read_frame(bytes(broken), 0)
    with pytest.raises(ValueError):
        binary.read_frame(record[:-1], 0)


@pytest.mark.parametrize("seed", range(30))
def test_patterns_place_every_length(seed):
    draw = random.Random(seed)
    capacity = draw.choice((5, 16, 64, 200))
    counts = {draw.randint(1, capacity): draw.randint(1, 30) for _ in range(draw.randint(1, 40))}
    patterns = packing.plan_patterns(counts, capacity)
    placed = defaultdict(int)
    for lengths, times in patterns:
        assert times > 0 and sum(lengths) <= capacity
        for n in lengths:
            placed[n] += times
    assert placed == counts
    # Best fit, longest first, one by one.
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - n)
    used = sum(times for _, times in patterns)
    assert used <= len(gaps)


def test_exact_fillings_are_found():
    assert packing.plan_patterns({6: 4, 4: 4}, 10) == [((6, 4), 4)]
    assert packing.plan_patterns({7: 2, 2: 2, 1: 2}, 10) == [((7, 2, 1), 2)]
    assert sum(times for _, times in packing.plan_patterns({5: 3, 3: 3, 2: 3, 1: 3}, 11)) == 3
    with pytest.raises(ValueError):
        packing.plan_patterns({11: 1}, 10)


def _plain_minimax(sizes, n):
    def enough(capacity):
        used, room = 0, -1
        for size in sizes:
            if size > room:
                used, room = used + 1, capacity
            if size > room:
                return False
            room -= size
        return used <= n

    capacity = max(sizes)
    while not enough(capacity):
        capacity += 1
    return capacity


@pytest.mark.parametrize("seed", range(40))
def test_minimax_is_the_smallest_capacity(seed):
    draw = random.Random(seed)
    keys = sorted(draw.sample(range(-10**6, 10**6), draw.randint(1, 200)))
    sizes = [int(draw.paretovariate(1.2) * 10) for _ in keys]
    n, parts = draw.randint(1, 12), draw.choice((2, 3, 50))

    def refine(some):
        out = []
        for r in some:
            width, split = max(1, -(-(r.high - r.low + 1) // parts)), defaultdict(list)
            for key, size in zip(keys, sizes, strict=True):
                if r.low <= key <= r.high:
                    split[(key - r.low) // width].append((key, size))
            out += [shards.Range(v[0][0], v[-1][0], sum(s for _, s in v), len(v)) for _, v in sorted(split.items())]
        return out

    capacity, ends = shards.minimax_cuts(refine([shards.Range(keys[0], keys[-1], sum(sizes), len(keys))]), n, refine)
    assert capacity == _plain_minimax(sizes, n)
    filled = [0] * (len(ends) + 1)
    for key, size in zip(keys, sizes, strict=True):
        filled[sum(key > end for end in ends)] += size
    assert max(filled) <= capacity and len(filled) <= n


def test_distance():
    draw = random.Random(2)

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    for _ in range(500):
        p = "".join(draw.choices("ab c", k=draw.randint(1, 80)))
        t = "".join(draw.choices("abc ", k=draw.randint(0, 90)))
        assert decontam.best_distance(p, t, 99) == plain(p, t)
        assert decontam.best_distance(p, t, plain(p, t) - 1) is None


def test_phrases_of_a_parse():
    text = "abababcabcabcd"
    seen = set()
    lengths, rest = phrases.parse(text, seen)
    assert (lengths, rest) == ([1, 1, 2, 3, 4, 2, 1], "") and seen == {"a", "b", "ab", "abc", "abca", "bc", "d"}
    assert phrases.parse("ab", seen) == ([], "ab")
    whole = phrases.fingerprint("some text " * 30)
    assert np.array_equal(whole, phrases.values_of(phrases.text_of(whole)))
    assert phrases.likeness(whole, whole) == 1 and phrases.likeness(whole, phrases.fingerprint("")) == 0


def test_phrase_hashes_depend_on_content_only():
    a = phrases.phrase_hashes("xyabcab", [2, 3, 2])
    b = phrases.phrase_hashes("abcabxy", [3, 2, 2])
    assert sorted(a.tolist()) == sorted(b.tolist()) and len(set(a.tolist())) == 3


@pytest.mark.parametrize("seed", range(30))
def test_strings_that_start_earlier(seed):
    draw = random.Random(seed)
    length = draw.choice((2, 3, 5, 8))
    strings = [
        bytes(draw.choice(b"ab") if draw.random() < 0.9 else draw.randrange(256) for _ in range(draw.randint(0, 40)))
        for _ in range(draw.randint(1, 6))
    ]
    ids = np.array([draw.randrange(3) for _ in strings])
    starts = np.array([100 * i for i in range(len(strings))])
    found, seen, want = [], set(), []
    for i, s in enumerate(strings):
        found += [(int(ids[i]), int(starts[i]) + at, s[at : at + length]) for at in range(len(s) - length + 1)]
    for own, at, content in sorted(found):
        if content in seen:
            want.append((own, at))
        seen.add(content)
    got = bwt.later_copies(strings, ids, starts, length)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want


@pytest.mark.parametrize("seed", range(15))
def test_each_string_has_the_first_smallest_anchor(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(draw.randint(1, 4)):
        n, kinds = draw.randint(100, 600), draw.choice((1, 2, 5, 26))
        text = bytes(draw.randrange(97, 97 + kinds) for _ in range(n))
        texts.append((text[: draw.randint(1, 9)] * n)[:n] if draw.random() < 0.3 else text)
    text, anchor, low, high, _ = repeats.stretches(texts)
    for i, data in enumerate(texts):
        grams = repeats._gram_hashes(np.frombuffer(data, np.uint8))
        want = [s + int(np.argmin(grams[s : s + repeats.WIDTH])) for s in range(len(data) - repeats.LENGTH + 1)]
        got = [a for a, x, y in zip(anchor[text == i], low[text == i], high[text == i], strict=True) for _ in range(x, y + 1)]
        assert got == want


def test_alignment_goes_through_gaps():
    a = "the quick brown fox jumps over the lazy dog and the cat".split()
    b = "so the quick red fox jumps and jumps over the lazy dog and then the cat".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[k] for i, k in pairs) and pairs == sorted(pairs)
    assert [a[i] for i, _ in pairs] == "the quick fox jumps over the lazy dog and the cat".split() or len(pairs) >= 10
    assert licenses.align([], b) == [] and licenses.align(a, a) == [(i, i) for i in range(len(a))]


def test_notices():
    templates = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    line = "Licensed under the Apache License, Version 2.0."
    text = f"Some words. {line} More words here. {line} {line}\nAll Rights\tReserved"
    found = licenses.notices(text, templates, 0.8)
    assert [name for name, *_ in found].count("Apache-2.0") == 3
    assert ("proprietary", text.index("All"), len(text), 1.0) in found
    changed = "Permission is hereby given free of charge to any person obtaining a copy of this software and its associated documentation files, to deal in the Software without any restriction"
    assert [(n, c > 0.85) for n, _, _, c in licenses.notices(changed, templates, 0.8)] == [("MIT", True)]
    assert licenses.notices("license license all rights", templates, 0.8) == [] == licenses.notices(None, templates, 0.8)
