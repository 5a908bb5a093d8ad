"""Plain Python versions of the contracts, to hold the Spark results against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str | bytes) -> str:
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def luhn(d: str) -> bool:
    return sum((x * 2 - 9 * (x > 4) if i % 2 else x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def spans(text: str | None, kinds: dict) -> list[tuple[int, int, str, int]]:
    return [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m)]


def op1(text: str | None) -> dict:
    found = spans(text, PII)
    return {f"n_{k}": sum(x[2] == k for x in found) for k in PII} | {"base_sha256": sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in found))}


def op10(text: str | None) -> dict:
    found = sorted(spans(text, SECRETS))
    return {f"n_{k}": sum(x[2] == k for x in found) for k in SECRETS} | {"base_sha256": sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in found))}


def op4(text: str | None) -> dict:
    text = text or ""
    w = WORD.findall(text)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
    return out | {"base_failed": len(w) < 20 or 100 * len(hit) > 30 * len(w)}


def op2(texts: list[str | None], length: int = 400) -> list[dict]:
    """Per text: bytes, removed bytes, runs and the digest of what stays."""
    data = [(t or "").encode() for t in texts]
    seen: Counter = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        upto = 0
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                for j in range(max(i, upto), i + length):
                    gone[j] = 1
                upto = i + length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append({"n_bytes": len(d), "n_removed": sum(gone), "n_spans": runs, "kept_sha256": sha(bytes(b for b, g in zip(d, gone) if not g))})
    return out


def token_set(text: str | None, n: int) -> set:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def op6(ids: list[int], texts: list[str | None], n: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, component) by comparing all pairs that share anything."""
    sets = [token_set(t, n) for t in texts]
    post: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    shared: Counter = Counter()
    for p in post.values():
        if len(p) > 1:
            shared.update((a, b) for k, a in enumerate(p) for b in p[k + 1 :])
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            root[find(a)] = find(b)
    low: dict[int, int] = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, d in enumerate(ids)}


def op7(texts: list[str | None]) -> list[dict]:
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    pack = lambda x: b"".join(i.to_bytes(4, "little") for i in x)
    return [{"n_tokens": len(x), "ids_sha256": sha(pack(x)), "decoded_sha256": sha(t.decode(x, skip_special_tokens=False))} for x in ids]


def disclosing(texts: list[str | None], context: int = 120, support: int = 2, share: float = 0.9) -> list[list[tuple]]:
    """The added spans (kind, start, end) of each text, from plain counts over all texts."""
    import math

    import regex

    term = regex.compile(r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{2,}+")
    terms = lambda t: {m.lower() for m in term.findall(re.sub(PII["email"][0], " ", t))}
    seen: dict = {}
    for t in texts:
        t = t or ""
        for s, _, k, e in spans(t, PII):
            left, right = t[max(0, s - context) : s], t[e : e + context]
            left = re.sub(r"^[^\x20\x09-\x0D]*", "", left) if s > context else left
            right = re.sub(r"[^\x20\x09-\x0D]*$", "", right) if len(right) == context else right
            seen.setdefault(f"{k}:{t[s:e].lower()}", set()).add(tuple(sorted(terms(" ".join(x for x in (left, right))))))
    own = {t or "": terms(t or "") for t in texts}
    n, held = len(own), Counter(x for ws in own.values() for x in ws)
    told = set()
    for contexts in seen.values():
        if len(contexts) >= support:
            for w, c in Counter(x for ws in contexts for x in ws).items():
                pmi = math.log2(c * n / (len(contexts) * max(held[w], c)))
                if c >= support and pmi >= math.log2(n) / 2 - 1e-12 and pmi >= share * math.log2(n / len(contexts)) - 1e-12:
                    told.add(w)
    out = []
    for t in texts:
        base = spans(t, PII)
        found = [m.span() for m in term.finditer(t or "") if m[0].lower() in told & own[t or ""]]
        out.append([("term", s, e) for s, e in found if not any(a < e and s < b for a, _, _, b in base)])
    return out


def linked(text: str | None, scope: int = 200) -> list[tuple]:
    """The weak parts (kind, start, end) of a text that have a complementary part in reach."""
    import regex

    from gneiss.llm.secrets import ROLE, WEAK

    weak = [(m.start(), list(ROLE).index(k), k, m.end()) for k, p in WEAK.items() for m in regex.finditer(p, text or "")]
    base = spans(text, SECRETS)
    asks = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("identifier", "secret")}
    near = lambda x: any(abs(y[0] - x[0]) <= scope and ROLE[y[2]] in asks[ROLE[x[2]]] for y in weak + base)
    return [(k, s, e) for s, o, k, e in sorted(weak) if near((s, o, k, e)) and not any(a < e and s < b for a, _, _, b in base)]


def op9(texts: dict[int, str | None], known: dict[int, int]) -> tuple[list[str], float, dict[int, float]]:
    """Words that tell, class prior and scores by id, by dense matrices over all texts with distinct ids."""

    def parts(text: str | None) -> set[str]:
        words = {w for w in re.split(r"[\W\d_]+", (text or "").lower()) if w}
        return words.union(w[:5] + "*" for w in words if len(w) > 5)

    learn = [i for i in texts if i is not None and zlib.crc32(str(i).encode()) % 5]
    u = [parts(texts[i]) for i in learn]
    p = [x for i, x in zip(learn, u) if known.get(i)]
    tell, prior = [], 1.0
    for w in set().union(*p):
        k = sum(w in x for x in p)
        if k < 5:
            continue
        a, b = k / len(p), sum(w in x for x in u) / len(u)
        da, db = (a * (1 - a) / len(p)) ** 0.5, (b * (1 - b) / len(u) + len(u) ** -2) ** 0.5
        if a > da:
            prior = min(prior, (b + db) / (a - da))
        if (a - b) / (da**2 + db**2) ** 0.5 > 4 and a > 1.5 * b:
            tell.append(w)
    tell.sort()
    prior = min(max(prior, 1e-3), 0.3)
    dense = lambda rows: np.array([[float(w in x) for w in tell] + [1.0] for x in rows])
    p, u, w = dense(p), dense(u), np.append(np.zeros(len(tell)), np.log(prior / (1 - prior)))
    m = v = np.zeros(len(w))
    for t in range(1, 401):
        gp, gu = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        clean = u.T @ gu / len(u) - prior * p.T @ gp / len(p)
        at_zero = prior * np.log(1 - gp).mean() > np.log(1 - gu).mean()
        grad = prior * p.T @ (gp - 1) / len(p) + clean if at_zero else -clean
        grad += 1e-4 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    ids = list(texts)
    return tell, prior, dict(zip(ids, 1 / (1 + np.exp(-dense([parts(texts[i]) for i in ids]) @ w))))


def op11(rows: list[tuple]) -> dict:
    """conv_id: (turns, their digest, characters of replies, their digest, characters of all texts) of rows (conv_id, turn, role, text)."""
    held: dict = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss), sum(len(t) for *_, t in turns)
    return out


def op12(rows: list[tuple], most: int = 8) -> dict:
    """vec_id: (n, deviation, whitened, explained) by exact sums and a dense eigensolver."""
    from fractions import Fraction

    good = [(i, [int(np.floor(1024 * float(c))) + 100_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    n, sums = len(good), [sum(x) for x in zip(*(v for _, v in good))]
    far = [[n * x - s for x, s in zip(v, sums)] for _, v in good]
    y = np.array([[float(Fraction(f, n)) for f in row] for row in far])
    e, basis = np.linalg.eigh(y.T @ y / n)
    e, basis = e[::-1], basis[:, ::-1]
    w = y @ basis[:, :most] / np.sqrt(e[:most])
    return {i: (n, sum(f * f for f in row), x, e[:most] / e.sum()) for (i, _), row, x in zip(good, far, w)}


def op13(texts: list[str | None]) -> list[tuple]:
    """Figures of each text, its tokens compared end by end."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letter = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    bytes_a = lambda i: bytes(letter[c] for c in ta.id_to_token(i))

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for t in texts:
        groups: list = []
        if t:
            a, b, data = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t), (" " + t).encode()
            xa, xb = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
            if b"".join(xa) == data == b"".join(xb):
                i = j = at = to = 0
                own: tuple = ([], [])
                while i < len(a) or j < len(b):
                    if at <= to:
                        at, _ = at + len(xa[i]), own[0].append(a[i])
                        i += 1
                    else:
                        to, _ = to + len(xb[j]), own[1].append(b[j])
                        j += 1
                    while to < at:
                        to, _ = to + len(xb[j]), own[1].append(b[j])
                        j += 1
                    if at == to:
                        groups.append(own)
                        own = ([], [])
        found.append(groups)
        counts.update((g[0][-1], g[1][-1]) for g in groups)
    best: dict = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for groups in found:
        ns = [(counts[g[0][-1], g[1][-1]], best[g[1][-1]]) for g in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(groups), sum(n == m for n, m in ns), sum(n for n, _ in ns), sha(text) if groups else ""))
    return out
