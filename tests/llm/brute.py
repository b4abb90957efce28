"""Plain versions of the operators, from their definitions."""

import hashlib
import re
import zlib

import numpy as np
import xxhash
from tokenizers import Tokenizer


def ids_of(path, text, end=None):
    found = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids if isinstance(path, str) else path.encode(text or "", add_special_tokens=False).ids
    return np.array(found + ([end] if end is not None else []), dtype="<u4")


def repeats(rows, window):
    first, out = {}, []
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc), doc)
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    return (*(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest())


def fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, max_bits=3):
    """The least index that each fingerprint reaches."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= max_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def similar_roots(texts, share=0.8):
    """The smallest id that each text reaches over pairs with that much of their five-word runs in common."""
    sets, root, holders = {}, {d: d for d in texts}, {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    pairs = {(a, b) for found in holders.values() for a in found for b in found if a < b}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def shingle_set(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def contained(docs, items, share=0.8):
    sets = {i: shingle_set(t) for i, t in items}
    out = []
    for doc, text in docs:
        have, w = shingle_set(text), re.findall(r"[^\W_]+", (text or "").lower())
        have |= {" ".join(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1)}
        for i, s in sets.items():
            n = len(s & have)
            if s and n >= share * len(s) - 1e-9:
                out.append((i, doc, len(s), n))
    return sorted(out)


def pieces(path, docs, end=0, capacity=2048):
    tokenizer, out = Tokenizer.from_file(path), {}
    for doc, text in docs:
        ids = ids_of(tokenizer, text, end)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out[(doc, k)] = (at, len(part), zlib.crc32(part.tobytes()))
    return out


def packing_is_valid(rows, capacity=2048):
    """Gapless offsets from 0 and no sequence above capacity; returns the number of sequences."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)



def damaged_rows(rows):
    """Conversations after the damage, each as rows in order."""
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def conversation(rows):
    """What operator 13 returns for one conversation, by dynamic programming over whole audits."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # (cost, audit, repaired) of the cheapest way to have put out roles that leave each state
    order = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def spread(best):
        """Insertions, until nothing gets better."""
        changed = True
        while changed:
            changed = False
            for (state, to), then in order.items():
                if state in best and to in names:
                    cost, audit, put = best[state]
                    new = (cost + 5, audit + "I", (*put, f"{names[to]}:"))
                    if then not in best or new[:2] < best[then][:2]:
                        best[then], changed = new, True
        return best

    best = spread({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, put) in best.items():
            late = 5 if fault == "t" else 0
            ways = [(state, (cost + 2, audit + "D", put))]
            if fault not in ("b", "d"):
                if (state, role[:1]) in order:
                    ways.append((order[state, role[:1]], (cost + late, audit + "K", (*put, f"{role}:{text}"))))
                for to, name in names.items():
                    if (state, to) in order:
                        ways.append((order[state, to], (cost + 1 + late, audit + "R", (*put, f"{name}:{text}"))))
            for to, way in ways:
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        best = spread(after)
    cost, audit, put = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(put).encode()).hexdigest()


class KneserNey:
    """Interpolated Kneser-Ney over the bytes of words, by class, from its definition."""

    def __init__(self, rows, order=5, shared=2, discount=0.75):
        self.order, self.discount, self.full, self.sums = order, discount, {k: {} for k in range(1, order + 1)}, {}
        for text, toxic in rows:
            for w in self.words(text):
                for g in self.grams(w):
                    self.full[len(g)].setdefault(g, [0, 0])[toxic] += 1
        for k in range(order - 1, 0, -1):
            for g, n in self.full[k + 1].items():
                adjusted = self.full[k].setdefault(g[1:], [0, 0])
                for c in (0, 1):
                    adjusted[c] += n[c] > 0
        for k in range(1, order + 1):
            for g, n in self.full[k].items():
                if k <= shared:
                    n[:] = [sum(n)] * 2
                total = self.sums.setdefault((k, g[:-1]), [[0, 0], [0, 0]])
                for c in (0, 1):
                    total[c][0] += n[c]
                    total[c][1] += n[c] > 0

    @staticmethod
    def words(text):
        return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()).split()

    def grams(self, word):
        body = b"\x02" + word + b"\x03"
        return [body[max(0, i - self.order + 1) : i + 1] for i in range(1, len(body))]

    def chance(self, gram, c):
        if not gram:
            return 1 / 256
        shorter = self.chance(gram[1:], c)
        total, kinds = self.sums.get((len(gram), gram[:-1]), [[0, 0], [0, 0]])[c]
        if not total:
            return shorter
        return max(self.full[len(gram)].get(gram, [0, 0])[c] - self.discount, 0) / total + self.discount * kinds / total * shorter

    def ratio(self, text):
        return sum(np.log(self.chance(g, 1) / self.chance(g, 0)) for w in self.words(text) for g in self.grams(w))


def phrase_rows(docs, least=30, top=2000):
    """Operator 11 by counting every run of up to four words."""
    counts = {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        mine = counts.setdefault(lang, {})
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = [x for x in re.split(rb"[\x20\x09]+", piece) if x]
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = tuple(w[i : i + k])
                    mine[key] = mine.get(key, 0) + 1
    out = []
    for lang, f in counts.items():
        n = sum(x for p, x in f.items() if len(p) == 1)
        rows, covered = [], {}
        for p, a in f.items():
            if len(p) >= 2 and a >= least:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((p, a, f[p[:k]], f[p[k:]], score))
                for m in range(2, len(p)):
                    for i in range(len(p) - m + 1):
                        covered[p[i : i + m]] = max(covered.get(p[i : i + m], 0), a)
        rows = sorted((r for r in rows if 100 * covered.get(r[0], 0) < 80 * r[1] or r[0] not in covered), key=lambda r: (-r[4], -r[1], b" ".join(r[0])))
        out += [(lang, i, b" ".join(p).decode(), a, left, right, n, score) for i, (p, a, left, right, score) in enumerate(rows[:top], 1)]
    return sorted(out)


class GramSets:
    """Language identification with plain sets of 4-grams in place of filters."""

    def __init__(self, rows, least=3, sighting=10_000, share=0.5):
        counts = {}
        for text, lang in rows:
            mine = counts.setdefault(lang, {})
            for g in self.grams(text):
                mine[g] = mine.get(g, 0) + 1
        total = {x: sum(c.values()) for x, c in counts.items()}
        best = {}
        for x, c in counts.items():
            for g, n in c.items():
                best[g] = max(best.get(g, 0), n / total[x])
        self.sets = {x: {g for g, n in c.items() if n >= min(least, -(-total[x] // sighting)) and n / total[x] >= share * best[g]} for x, c in counts.items()}

    @staticmethod
    def grams(text):
        words = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()).split()
        body = b" " + b" ".join(words).ljust(2) + b" " if words else b""
        return [body[i : i + 4] for i in range(len(body) - 3)]

    def shares(self, text):
        grams = self.grams(text)
        return {x: sum(g in s for g in grams) / max(1, len(grams)) for x, s in sorted(self.sets.items())}
