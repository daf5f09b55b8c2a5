"""Small tables with everything that real ones may hold, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` int, `slot.n` string, score double, _text string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "né", "tru", "son", "pel", "ist", "or", "ä"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words))


def odd_texts() -> list[tuple[int | None, str | None]]:
    long_text = prose(1, 40_000)
    plain, passage = prose(2, 120), prose(3, 40)
    return [
        (1, "A b c"),
        (2, ""),
        (3, None),
        (None, plain),
        (None, None),
        (None, prose(4, 60)),
        (5, long_text),
        (5, "another text of five " + passage),
        (7, plain),
        (7, plain),
        (8, plain + " ende"),
        (9, "   \n\t \r\n"),
        (10, "😀 naïve " + passage + " 漢字 e\u0301"),
        (11, "a" * 3000),
        (12, "### $$$ " * 40 + "\n" + passage),
        (13, "same same " * 200),
        (14, "Licensed under CC BY-NC 4.0.\n" + prose(5, 30)),
        (15, "x" * 99),
        (16, "x" * 99),
        (17, long_text[:5000] + "!" + long_text[5000:]),
        (18, "\x00\x1c\x85\u2028 control"),
    ]


def documents(spark, rows=None):
    rows = odd_texts() if rows is None else rows
    made = [(i, t, None, "s", None if t is None else len(t), "r", 3, "d", 0.1, "other") for i, t in rows]
    return spark.createDataFrame(made, SCHEMA)


def fingerprint(text, size=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Root of each place, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def removed(rows, width=100):
    """For each row the bytes inside strings that start earlier, too."""
    def place(i):
        key, text = rows[i]
        data = text or ""
        tie = hashlib.md5(data.encode()).digest()
        if key is None:
            signed = (lambda h: h - (1 << 64) if h >> 63 else h)
            return (1, signed(xxhash.xxh64_intdigest(data.encode(), 42)) if text is not None else 42, tie, i)
        return (0, key, tie, i)

    seen, flags = set(), [None] * len(rows)
    for i in sorted(range(len(rows)), key=place):
        data = (rows[i][1] or "").encode()
        own = bytearray(len(data))
        for start in range(len(data) - width + 1):
            piece = data[start : start + width]
            if piece in seen:
                own[start : start + width] = b"\1" * width
            seen.add(piece)
        flags[i] = own
    return flags


def spans(flags):
    out, start = [], None
    for i, flag in enumerate([*flags, 0]):
        if flag and start is None:
            start = i
        elif not flag and start is not None:
            out.append((start, i))
            start = None
    return out


def phrase_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, width=13):
    words, hit, found = phrase_words(text), set(), set()
    for item, item_text in items:
        own = phrase_words(item_text)
        for start in range(max(1, len(own) - width + 1) if own else 0):
            window = own[start : start + width]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def base_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingle_set(text, size=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def similar_components(texts, least=0.8):
    """Root of each place, by the similarity of all pairs."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            shared = len(x & y)
            if x == y or shared and shared >= least * (len(x) + len(y) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]
