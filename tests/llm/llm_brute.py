"""Plain-Python versions that the operators are compared with."""

import hashlib
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
FAR = 2**63 - 1


def words(text, lower=False):
    text = text or ""
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def linked(docs, n, num, den):
    """id, set size and least reachable id of each row, in input order."""
    sets = []
    for _, text in docs:
        w = words(text, lower=True)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in where.get(g, []))
        for j, k in common.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            where.setdefault(g, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(docs)]


def without_repeats(docs, window):
    """id, words, removed words and kept words of each row."""
    texts = [(FAR if i is None else i, words(t)) for i, t in docs]
    low = {}
    for i, w in texts:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            low[k] = min(low.get(k, i), i)
    out = []
    for (i, w), (own, _) in zip(texts, docs, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((own, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def without_recurring(docs, depth=3, min_docs=10, similar=0.7, min_tokens=1):
    """id, lines with a word, dropped lines and text of each row, by the rule in the docstring of templates."""

    def parsed(line):
        tokens = words(line)
        masked = [None if re.search("[0-9]", t) else t for t in tokens]
        body = tuple(tokens) if not any(masked) else ("masked", *masked)
        return (len(tokens), *masked[:depth]), body, masked

    split = [[(x, parsed(x)) for x in (t or "").split("\n")] for _, t in docs]
    held = [{(leaf, body): m for _, (leaf, body, m) in x if len(m) >= min_tokens} for x in split]
    times = Counter(k for h in held for k in h)
    tokens = {k: m for h in held for k, m in h.items()}
    places = Counter()
    for k, n in times.items():
        places.update({(k[0], p, t): n for p, t in enumerate(tokens[k]) if t})
    template, alike = {}, set()
    for k, m in tokens.items():
        constant = tuple((p, t) for p, t in enumerate(m) if t and places[k[0], p, t] >= min_docs)
        template[k] = (k[0], constant) if len(constant) / len(m) >= similar else k
        if len(constant) / len(m) >= similar:
            alike.add(k)
    seen = Counter()
    for k, n in times.items():
        seen[template[k]] += n
    common = {k for k in times if seen[template[k]] >= min_docs}
    heads = {tuple(tokens[k][:3]) for k in common if len(tokens[k]) >= 6}
    tails = {tuple(tokens[k][-3:]) for k in common if len(tokens[k]) >= 6}
    kin = {k for k, m in tokens.items() if len(m) >= 6 and (tuple(m[:3]) in heads or tuple(m[-3:]) in tails)}
    votes = {}
    for h in held:
        own = frozenset(h) - common - alike - kin
        rare = sorted({(seen[template[k]], str(template[k])) for k in h if k in common})
        for k in common & set(h):
            other = [r for r in rare if r[1] != str(template[k])][:1]
            votes.setdefault(template[k], set()).add(own or tuple(other))
    gone = {k for k in common if len(votes[template[k]]) >= min_docs}
    out = []
    for (doc_id, text), x in zip(docs, split, strict=True):
        stay = [line for line, (leaf, body, _) in x if (leaf, body) not in gone]
        out.append((doc_id, sum(1 for _, (_, _, m) in x if m), len(x) - len(stay), None if text is None else "\n".join(stay)))
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def by_text(rows):
    return sorted(rows, key=str)


def thue_morse(n: int, letters: str = "ab") -> str:
    """The letters by the parity of each place's set bits: strings on which polynomials modulo 2**64 collide."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))
