"""Brute-force versions of the operators, one document after the other."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def encode(docs):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t in docs for ids in [sp.encode(t or "")]]


def counts(docs, name="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, len((x or "").encode()), n, n > 2048) for i, x in docs for n in [len(t.encode(x or "", add_special_tokens=False).ids)]]


def decontaminate(docs, bench):
    windows = collections.defaultdict(set)
    for item, t in bench:
        w = ALNUM.findall(low(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if n and item is not None else 0):
            windows[tuple(w[a : a + n])].add(str(item))
    out = []
    for i, t in docs:
        w, items = ALNUM.findall(low(t)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit[a : a + n] = [1] * n
                    items |= windows[k]
        out.append((i, len(w), sum(hit), len(items), sha(",".join(sorted(items))), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def licenses(docs):
    out = []
    for i, t in docs:
        w, found = ALNUM.findall(low(t)), []
        for p, label in PHRASES.items():
            q = p.split()
            found += [(a, label) for a in range(len(w) - len(q) + 1) if w[a : a + len(q)] == q]
        at = [a for a, _ in found]
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out


def license_labels(docs, templates, coverage=0.6, density=0.5, neighbours=4, gap=24):
    """(id, labels, score, spans): every document is aligned with every template, pair of words by pair of words, without votes."""
    out = []
    for i, t in docs:
        w, spans = ALNUM.findall(low(t)), []
        for name, (label, text) in templates.items():
            q = ALNUM.findall(low(text))
            best = {}  # (place in document, place in template) -> (matches, start)
            for a in range(len(w) - 1):
                for b in range(len(q) - 1):
                    if w[a : a + 2] == q[b : b + 2]:
                        before = [best[c, d] for c in range(max(0, a - gap), a) for d in range(max(0, b - (a - c) - neighbours), min(b, b - (a - c) + neighbours + 1)) if (c, d) in best]
                        n, start = max(before, default=(0, a))
                        best[a, b] = (n + 1, start)
            ends = sorted((-n, a - start, a, start) for (a, _), (n, start) in best.items() if n >= coverage * (len(q) - 1) and n >= density * (a - start + 1))
            taken = []
            for minus, _, a, start in ends:
                if all(a + 2 <= s or e <= start for s, e in taken):
                    taken.append((start, a + 2))
                    spans.append((-minus / (len(q) - 1), start, a + 2, name, label))
        best = [s for s in spans if not any(o[0] > s[0] and o[1] < s[2] and s[1] < o[2] for o in spans)]
        phrases = {label for p, label in PHRASES.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()}
        out.append((i, ",".join(sorted(phrases | {s[4] for s in best})), 1.0 if phrases else max((s[0] for s in best), default=0.0), sorted(s[1:4] for s in best)))
    return out


def chat(rows):
    """The lines of (conv_id, turn, role, text) and of the calls and results that the query derives from them."""
    import json

    line = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    name = lambda conv, turn: f"c{conv}-{turn}"
    own = collections.Counter(name(c, t) for c, t, role, _ in rows if role == "assistant")
    answered = {name(c, t - 1) for c, t, role, _ in rows if role == "user"}
    first = {}
    for c, t, role, _ in rows:
        if role == "assistant":
            first[name(c, t)] = min(first.get(name(c, t), (c, t)), (c, t))

    def level(c, t):
        return level(c, t - 2) + 1 if name(c, t - 2) in own else 0

    out = []
    for c, t, role, text in rows:
        out.append((c, t, 0, None, None, "ok", line({"content": text, "role": role})))
        if role == "assistant":
            tool = "fetch" if c % 13 == 0 else "search" if t % 4 == 1 else "lookup"
            arguments = ({} if text is None else {"query": text}) | {"limit": t}
            broken = c % 17 == 0
            bad = tool == "search" and (not arguments.get("query") or not 1 <= t <= 5) or "query" not in arguments
            status = "unknown_tool" if tool == "fetch" else "bad_json" if broken else "bad_arguments" if bad else "ok" if name(c, t) in answered else "no_result"
            status = "repeated_id" if own[name(c, t)] > 1 else status
            if tool == "fetch" or broken:
                raw = json.dumps(arguments, ensure_ascii=False, separators=(",", ":"))
                shown = "{" + raw if broken else raw
            else:
                shown = arguments
            out.append((c, t, 1, name(c, t), level(c, t), status, line({"role": "assistant", "tool_calls": [{"arguments": shown, "id": name(c, t), "name": tool, "needs": [name(c, t - 2)]}]})))
        if role == "user":
            call = name(c, t - 1)
            at = first.get(call, (None, None))
            out.append((*at, 2, call, level(*at) if call in first else None, "ok" if call in first else "orphan", line({"content": text, "role": "tool", "tool_call_id": call})))
    return out


def shingles(t, size=4):
    w = SPACED.findall(low(t))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[a : a + size]) for a in range(len(w) - size + 1)])


def near(docs, size=4):
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    names = collections.defaultdict(list)
    for k in range(len(docs)):
        names[root(k)].append(docs[k][0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return [(i, len(sets[k]), first[root(k)], i == first[root(k)]) for k, (i, _) in enumerate(docs)]


def top(rows, k=10):
    whole = [(i, np.array([int(np.floor(1024 * float(x))) for x in v], object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in whole if i % 100 == 0}.items():
        found = sorted((-sum(int(a) * int(b) for a, b in zip(v, x, strict=False)), i) for i, x in whole if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], start=1)]
    return out


def substrings(docs, width=20):
    """docs in the order in which they count as earlier"""
    seen, out = set(), []
    for i, t in docs:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            if k in seen:
                gone[a : a + width] = [True] * width
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return out


def held_out(ids, n):
    """Ids whose xxhash64 (Spark's, seed 42) is a multiple of n."""
    import struct

    import xxhash

    signed = {i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))[0] for i in ids}
    return {i for i, h in signed.items() if h % n == 0}


def kneser_ney(words, order):
    """log p(character | the order - 1 before it) of an interpolated modified Kneser-Ney model of {word: count}."""
    top = collections.Counter()
    for w, n in words.items():
        padded = "\x02" * (order - 1) + w + "\x03"
        for i in range(len(w) + 1):
            top[padded[i : i + order]] += n
    levels = [top]
    for _ in range(order - 1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
    tables = []
    for counts in levels:
        n1, n2, n3, n4 = (max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        after = collections.defaultdict(dict)
        for g, n in counts.items():
            after[g[:-1]][g[-1]] = n
        tables.append((d, after))

    def p(context, c):
        lower = p(context[1:], c) if context else 1 / 4096
        d, after = tables[len(context)]
        if context not in after:
            return lower
        follow = after[context]
        total, cut = sum(follow.values()), sum(d[min(n, 3) - 1] for n in follow.values())
        own = follow.get(c, 0)
        return (own - d[min(own, 3) - 1]) / total + cut / total * lower if own else cut / total * lower

    return p


def perplexities(rows, trusted, order=4, letters=4):
    """(id, lang, text) -> (id, words, perplexity, perplexity of the least likely word) in the order of the rows."""
    import math
    import string

    words = collections.defaultdict(collections.Counter)
    for i, lang, t in rows:
        if i in trusted:
            words[lang or ""].update(x.decode() for x in (t or "").encode().split())
    models = {lang: kneser_ney(c, order) for lang, c in words.items() if c}
    known = {}

    def score(lang, w):
        if (lang, w) not in known:
            padded = "\x02" * (order - 1) + w + "\x03"
            known[lang, w] = sum(math.log(models[lang](padded[i : i + order - 1], padded[i + order - 1])) for i in range(len(w) + 1))
        return known[lang, w]

    out = []
    for i, lang, t in rows:
        own, lang = [x.decode() for x in (t or "").encode().split()], lang or ""
        if not own or lang not in models:
            out.append((i, len(own), None, None))
            continue
        mean = -sum(score(lang, w) for w in own) / sum(len(w) + 1 for w in own)
        peaks = [w for w in (x.strip(string.punctuation).lower() for x in own) if len(w) >= letters and w.isalpha()]
        out.append((i, len(own), math.exp(mean), max((math.exp(-score(lang, w) / (len(w) + 1)) for w in peaks), default=None)))
    return out


def judged(rows, labels, held_share, quantile, peak_quantile, margin):
    """Which of (id, lang, text) stay: both perplexities against the quantiles of their language over held-out trusted documents."""
    import math

    good = {i for i, q, t in labels if q == 1 and not t}
    held = held_out(good, held_share)
    scored, limit = perplexities(rows, good - held), {}
    for lang in {x for _, x, _ in rows}:
        for k, share in ((2, quantile), (3, peak_quantile)):
            own = sorted(w[k] for w, (i, x, _) in zip(scored, rows, strict=True) if x == lang and i in held and w[k] is not None)
            limit[lang, k] = own[math.ceil(share * len(own)) - 1] if own else math.inf
    return [(*w, (w[2] or 0) <= margin * limit[x, 2] and (w[3] or 0) <= margin * limit[x, 3]) for w, (_, x, _) in zip(scored, rows, strict=True)]


def pipeline(rows, labels, bench, quality):
    """(id, tokens, ids, digest of the decoded text) of (id, lang, text): the five stages, one after the other."""
    stays = judged(rows, labels, quality.HELD_OUT, quality.QUANTILE, quality.PEAK_QUANTILE, quality.MARGIN)
    docs = sorted((i, t) for (i, _, t), w in zip(rows, stays, strict=True) if w[4])
    docs = [d for d, x in zip(docs, near(docs, 5), strict=True) if x[3]]
    cut = []
    seen = set()
    for i, t in docs:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(k)
        cut.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t))
    clean = [d for d, x in zip(cut, decontaminate(cut, bench), strict=True) if not x[5]]
    return encode(clean)


def hard_negatives(rows, positives=5, negatives=3):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, vector, label)."""
    sound = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {i: min((label, v) for j, label, v in sound if j == i) for i, _, _ in sound if i % 50 == 0}
    out = []
    for i, (label, v) in anchors.items():
        met = sorted(((-score(v, w), j, other) for j, other, w in sound if j != i))
        for minus, p, _ in [m for m in met if m[2] == label][:positives]:
            fits = [m for m in met if m[2] != label and 50 * -minus <= 100 * -m[0] <= 95 * -minus]
            out += [(i, p, rank, m[1], -minus, -m[0]) for rank, m in enumerate(fits[:negatives], 1)]
    return out


def smallest_capacity(sizes, shards):
    """Of a shard, if groups stay in their order and one that is larger is a shard of its own; every capacity is tried."""
    for capacity in range(1, sum(sizes) + 1):
        needed, held = 0, None
        for s in sizes:
            if held is None or held + s > capacity:
                needed, held = needed + 1, 0
            held += s
        if needed <= shards:
            return capacity
    return 0


def spelling(docs, shortest=6, least=5, times=5, one_in=199):
    counts = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [o for o in words if near(w, o)] for w in words}
    form = {w: best for w, o in around.items() if o for best in [min(o, key=lambda x: (-words[x], x))] if words[best] >= times * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(around[w]), words.get(form.get(w))))
    return out
