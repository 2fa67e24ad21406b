"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def key(value):
    return (value is None, 0 if value is None else value)


def lowered(text):
    return (text or "").encode().lower().decode()


def contamination(documents, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall(lowered(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(None if item is None else str(item))
    out = []
    for doc_id, text in documents:
        words = pattern.findall(lowered(text))
        hit, found = set(), set()
        for n in range(1, window + 1):
            for i in range(len(words) - n + 1):
                if (own := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[own]
        found = sorted(found - {None})
        out.append((doc_id, len(words), len(hit), len(found), sha(",".join(found)), bool(hit)))
    return out


def repeats(documents, length=100):
    """documents in any order; rows without id come last."""
    seen, out = set(), []
    for doc_id, text in sorted(documents, key=lambda x: key(x[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if (own := data[i : i + length]) in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(own)
        spans = sum(1 for a, b in itertools.pairwise(b"\0" + gone) if b > a)
        out.append((doc_id, len(data), sum(gone), spans, sha(bytes(x for x, g in zip(data, gone) if not g))))
    return out


def fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = Counter()
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), seed=42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def components(prints, distance):
    """Smallest reachable id per row; prints are (id, fingerprint)."""
    label = list(range(len(prints)))
    for _ in prints:
        before = list(label)
        for i, j in itertools.combinations(range(len(prints)), 2):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    least = defaultdict(list)
    for (doc_id, _), c in zip(prints, label):
        least[c] += [doc_id] if doc_id is not None else []
    return [min(least[c], default=None) for c in label]


def lines(documents, least=40, least_documents=5):
    def line_key(line):
        return lowered(line.strip(SPACE))

    holders = defaultdict(list)
    for i, (doc_id, text) in enumerate(documents):
        for k in {line_key(x) for x in (text or "").split("\n")}:
            holders[k].append(doc_id)
    out = []
    for doc_id, text in documents:
        own = (text or "").split("\n")
        kept = []
        for line in own:
            k = line_key(line)
            known = [x for x in holders[k] if x is not None]
            if len(k) < least or len(holders[k]) < least_documents or not known or max(known) == doc_id:
                kept.append(line)
        out.append((doc_id, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(line.strip(SPACE))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def packs(lengths, capacity):
    """Number of bins of best-fit decreasing, one by one."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def _sums(word, pieces, chances):
    """Sums over all segmentations of the first n bytes, as fractions of two to the power of an exponent."""
    place = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))
    out = [(1.0, 0)]
    for end in range(1, len(word) + 1):
        found = [(start, place[word[start:end]]) for start in range(max(0, end - longest), end) if word[start:end] in place]
        top = max(out[start][1] for start, _ in found)
        fraction, exponent = math.frexp(sum(math.ldexp(out[start][0], out[start][1] - top) * chances[i] for start, i in found))
        out.append((fraction, exponent + top))
    return out


def segmentations(word, pieces, chances):
    """The logarithm of the sum over all segmentations of a word."""
    fraction, exponent = _sums(word, pieces, chances)[-1]
    return math.log(fraction) + exponent * math.log(2)


def piece_counts(word, pieces, chance):
    """Expected counts of pieces in a word, all of the same chance."""
    ahead = _sums(word, pieces, [chance] * len(pieces))
    turned = [p[::-1] for p in pieces]
    back = _sums(word[::-1], turned, [chance] * len(pieces))[::-1]
    out = [0.0] * len(pieces)
    place, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))
    for start in range(len(word)):
        for end in range(start + 1, min(start + longest, len(word)) + 1):
            i = place.get(word[start:end])
            if i is not None:
                (a, x), (b, y), (c, z) = ahead[start], back[end], ahead[-1]
                out[i] += math.ldexp(a * b / c * chance, x + y - z)
    return out
