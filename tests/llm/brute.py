"""Plain versions of the operators over lists of dicts; null ids are left to the tests of edge cases."""

import hashlib
import itertools
import math
import re
import struct
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return len(WORD.findall(text or ""))


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def near_duplicates(docs, k):
    """id -> (set size, smallest reachable id)."""
    sets = [shingles(d["text"], k) for d in docs]
    at = list(range(len(docs)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            at[root(j)] = root(i)
    least = {}
    for i, d in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], len(sets[i]), least[root(i)]) for i, d in enumerate(docs)]


def repeated(docs, length=100):
    """Masks of bytes, by position in docs; rows of one id count as one document."""
    first = {}
    texts = [(d["text"] or "").encode() for d in docs]
    order = sorted(range(len(docs)), key=lambda i: docs[i]["doc_id"])
    for i in order:
        for p in range(len(texts[i]) - length + 1):
            at = (docs[i]["doc_id"], p)
            s = texts[i][p : p + length]
            first[s] = min(first.get(s, at), at)
    out = []
    for d, b in zip(docs, texts, strict=True):
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (d["doc_id"], p):
                mask[p : p + length] = b"\1" * length
        out.append(bytes(mask))
    return out


def digests(text, mask):
    b = (text or "").encode()
    runs = len(re.findall(b"\1+", mask))
    return len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()


def targets(sizes, weights, share=1.5, most=2):
    """source -> target, by resharing excess round after round; sizes and weights by source."""
    budget = share * sum(sizes.values())
    held, out = {}, {}
    while True:
        free = {s: w for s, w in weights.items() if s not in held}
        left = budget - sum(held.values())
        out = held | {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        held |= {s: float(most * sizes[s]) for s in over}


def mix(docs, seed="mix-1"):
    """(id, size, source size, target, taken) in the order of docs."""
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + words(d["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aims = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    key = lambda d: (hashlib.md5(f"{'' if d['doc_id'] is None else d['doc_id']}|{seed}|{d['text'] or ''}".encode()).hexdigest(), words(d["text"]))
    taken = [0] * len(docs)
    for s in names:
        whole = math.floor(aims[s] / sizes[s]) if sizes[s] else 0
        more = math.floor(aims[s] - whole * sizes[s])
        for i in sorted((i for i, d in enumerate(docs) if d["source"] == s), key=lambda i: key(docs[i])):
            size = words(docs[i]["text"])
            part = max(0, min(size, more))
            more -= size
            taken[i] = whole * size + part
    return [(d["doc_id"], words(d["text"]), sizes[d["source"]], aims[d["source"]], t) for d, t in zip(docs, taken, strict=True)]


def pack(docs, n_buckets=8, budget=16384, seed="pack-1"):
    """(id, tokens, bucket, length, batch, slot) in any order; cuts by trying all of them, smaller cuts first."""
    sizes = sorted({words(d["text"]) for d in docs})
    counts = {s: sum(words(d["text"]) == s for d in docs) for s in sizes}
    best = {0: (0, ())}
    for k in range(min(n_buckets, len(sizes))):
        now = {}
        for j in range(k + 1, len(sizes) + 1):
            now[j] = min((best[i][0] + sum(counts[s] * (sizes[j - 1] - s) for s in sizes[i:j]), i, (*best[i][1], sizes[j - 1])) for i in best if i < j)
            now[j] = (now[j][0], now[j][2])
        best = now
    ends = best[len(sizes)][1] if sizes else ()
    out = []
    for b, end in enumerate(ends):
        rows = [d for d in docs if (ends[b - 1] if b else -1) < words(d["text"]) <= end]
        rows.sort(key=lambda d: (hashlib.md5(f"{'' if d['doc_id'] is None else d['doc_id']}|{seed}|{d['text'] or ''}".encode()).hexdigest(), words(d["text"])))
        per = max(1, budget // max(1, end))
        out += [(d["doc_id"], words(d["text"]), b, end, i // per, i % per) for i, d in enumerate(rows)]
    return out


def shards(docs, n=8):
    """(id, size, crc, shard, slot)."""
    rows = sorted(((d["doc_id"], zlib.crc32((d["text"] or "").encode()), len((d["text"] or "").encode()) + 1) for d in docs), key=lambda r: ((r[0] is not None), r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[2] for r in rows), 0, [], [0] * n
    for id_, crc, size in rows:
        s = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((id_, size, crc, s, slots[s]))
        slots[s] += 1
        before += size
    return out


def leaves(text):
    """Each paragraph's leaves: lines with their break, cut after white space that follows a stop, and after 64 characters."""
    out = []
    for line in (text or "").split("\n"):
        line += "\n"
        paragraph, now, stop = [], "", False
        for i, c in enumerate(line):
            now += c
            stop = (stop and c.isspace()) or (c in ".!?" and i + 1 < len(line) and line[i + 1].isspace())
            if (stop and c.isspace() and (i + 1 == len(line) or not line[i + 1].isspace())) or i + 1 == len(line):
                paragraph += [now[k : k + 64] for k in range(0, len(now), 64)]
                now, stop = "", False
        out.append(paragraph)
    return out


def tree_print(text):
    """The fingerprint, from the bottom up, and all leaves in order."""
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    sections, now = [], []
    paragraphs = leaves(text)
    for k, paragraph in enumerate(paragraphs):
        hashes = [h(x.encode("utf-8", "surrogatepass")) for x in paragraph]
        digest = h(b"P" + b"".join(hashes))
        now.append((digest, hashes))
        if not "".join(paragraph).strip() or digest[0] % 8 == 0 or k + 1 == len(paragraphs):
            sections.append((h(b"S" + b"".join(d for d, _ in now)), now))
            now = []
    root = h(b"R" + b"".join(d for d, _ in sections))
    body = ";".join(d.hex()[:8] + "=" + ",".join(p.hex()[:8] + "+" + ".".join(x.hex()[:8] for x in xs) for p, xs in ps) for d, ps in sections)
    return root.hex() + ":" + body, [x for p in paragraphs for x in p]


def dice_of(one, two):
    """2 * common / all of two lists, copies counted."""
    rest, both = list(two), 0
    for x in one:
        if x in rest:
            rest.remove(x)
            both += 1
    return 2 * both / (len(one) + len(two))


def first_difference(one, two):
    """The offset in two of the first leaf that differs."""
    at = 0
    for x, y in itertools.zip_longest(one, two):
        if x != y:
            return at
        at += len(y)
    return -1


def trigrams(text):
    """place -> count."""
    code = lambda b: b - 100 if b > 127 else ord(chr(b).lower()) - 96 if chr(b).isalpha() else 0
    c, out = [code(b) for b in text.encode()], {}
    for x, y, z in zip(c, c[1:], c[2:], strict=False):
        if gram := (x * 160 + y) * 160 + z:
            place = gram * 2654435769 % 2**32 >> 20
            out[place] = out.get(place, 0) + 1
    return out


class Language:
    """Nearest centroid in float64, over dictionaries."""

    def __init__(self, labelled, clusters=4, enough=10):
        grams = {lang: [trigrams(t) for t in sorted(ts, key=self._order)] for lang, ts in labelled.items()}
        n = sum(map(len, grams.values()))
        seen = {}
        for gs in grams.values():
            for g in gs:
                for p in g:
                    seen[p] = seen.get(p, 0) + 1
        self.idf, self.n = {p: math.log((1 + n) / (1 + k)) + 1 for p, k in seen.items()}, n
        self.centroids = [(lang, c) for lang in sorted(grams) for c in self._cluster([self.vector(g) for g in grams[lang]], clusters)]
        sizes = {}
        for gs in grams.values():
            for g in gs:
                sizes.setdefault(int(math.log2(max(1, sum(g.values())))), []).append(self.nearest(self.vector(g))[1])
        self.limits, low = {}, 0.0
        for s in range(33):
            if len(sizes.get(s, [])) >= enough:
                low = self._quantile(sizes[s], 0.01) / 2
                self.limits[s] = low
            elif self.limits:
                self.limits[s] = low

    @staticmethod
    def _order(text):
        g = sorted(trigrams(text).items())
        return b"".join(p.to_bytes(2, "little") for p, _ in g), b"".join(struct.pack("<f", n) for _, n in g)

    @staticmethod
    def _quantile(values, q):
        v = sorted(values)
        at = q * (len(v) - 1)
        return v[int(at)] + (at - int(at)) * (v[min(int(at) + 1, len(v) - 1)] - v[int(at)])

    def vector(self, grams):
        x = {p: math.log1p(k) * self.idf.get(p, math.log(1 + self.n) + 1) for p, k in grams.items()}
        return self._unit(x)

    @staticmethod
    def _unit(x):
        size = math.sqrt(sum(v * v for v in x.values()))
        return {p: v / size for p, v in x.items()} if size else x

    @staticmethod
    def _dot(x, y):
        return sum(v * y.get(p, 0.0) for p, v in x.items())

    def _sum(self, xs):
        out = {}
        for x in xs:
            for p, v in x.items():
                out[p] = out.get(p, 0.0) + v
        return out

    def _cluster(self, xs, k):
        mean = self._sum(xs)
        first = lambda values: max(range(len(values)), key=lambda i: (round(values[i], 9), -i))
        cs = [xs[first([self._dot(x, mean) for x in xs])]]
        while len(cs) < min(k, len(xs)):
            cs.append(xs[first([-max(self._dot(x, c) for c in cs) for x in xs])])
        for _ in range(12):
            mine = [first([self._dot(x, c) for c in cs]) for x in xs]
            cs = [self._unit(self._sum([x for x, m in zip(xs, mine, strict=True) if m == i])) for i in range(len(cs)) if i in mine]
        return cs

    def nearest(self, v):
        scores = [self._dot(v, c) for _, c in self.centroids]
        i = max(range(len(scores)), key=lambda i: (scores[i], -i))
        return self.centroids[i][0], scores[i]

    def __call__(self, text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0, True
        g = trigrams(text)
        lang, score = self.nearest(self.vector(g))
        return lang, score, score <= 0 or score < self.limits.get(int(math.log2(max(1, sum(g.values())))), 0.0)
