"""Plain versions of the learned operators and of the pipeline's stages, in numpy and Python without Spark.

They read the rows as lists and fit in one go; the operators must give the same scores.
"""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile("[ \t-\r]+")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def labelled(docs, labels, label):
    """(id, text, label) of the rows that may be learned from; ids are unique here."""
    by = {r["doc_id"]: r[label] for r in labels}
    return [(r["doc_id"], r["text"], by[r["doc_id"]]) for r in docs if r["text"] is not None and by.get(r["doc_id"]) is not None and fold(r["doc_id"]) != 2]


# --- toxicity: dense matrices ----------------------------------------------------------------------------------


def markers_of(text):
    words = {w for w in re.split(r"[\W_]+", (text or "").lower()) if w}
    return words | {w[:6] + "~" for w in words if len(w) > 6}


def toxic_scores(docs, labels):
    """P(grade >= 1) of each document, by a dense proximal gradient fit of the cumulative logit model."""
    times, share = Counter(), Counter()
    for _, text, y in labelled(docs, labels, "toxic"):
        times[text] += 1
        share[text] += y > 0
    texts = sorted(times, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    y = np.array([share[t] / times[t] >= 0.5 for t in texts]).astype(int)
    n = np.minimum([times[t] for t in texts], 4)
    found = [markers_of(t) for t in texts]
    count, clean = Counter(), Counter()
    for f, k, bad in zip(found, n, y):
        for x in f:
            count[x] += k
            clean[x] += not bad
    names = sorted(x for x in count if count[x] >= 4 and clean[x] <= max(4, 0.08 * (1 - y).sum()))
    place = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(texts), len(names)))
    for i, f in enumerate(found):
        x[i, [place[a] for a in f if a in place]] = 1
    x, y = np.repeat(x, n, 0), np.repeat(y, n)
    bad, good = x[y > 0].sum(0) / y.sum(), (x[y == 0].sum(0) + 0.5) / (1 - y).sum()
    marker = (bad > 20 * good) & (bad * y.sum() >= 4)
    hits = x[:, marker].sum(1)
    grade = np.where(y > 0, 1 + (hits >= 2) + (hits >= 4), 0)
    k = int(grade.max())
    reached = (grade[:, None] >= np.arange(1, k + 1)).astype(float)
    share = np.clip(reached.mean(0), 1e-3, 1 - 1e-3)
    v = np.ones(len(names)) / np.sqrt(len(names))
    for _ in range(20):
        u = x.T @ (x @ v)
        size = np.linalg.norm(u)
        v = u / size
    step = len(x) / (0.25 * k * (size * 1.05 + len(x)))
    w, theta = np.zeros(len(names)), np.log((1 - share) / share)
    wz, tz, momentum = w, theta, 1.0
    for _ in range(400):
        error = sigmoid((x @ wz)[:, None] - tz[None, :]) - reached
        new = wz - step * x.T @ error.sum(1) / len(x)
        new = np.sign(new) * np.maximum(np.abs(new) - step * 5e-4, 0)
        turned = np.sort(tz + step * error.mean(0))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        wz, tz = new + (momentum - 1) / after * (new - w), turned + (momentum - 1) / after * (turned - theta)
        w, theta, momentum = new, turned, after
    weight = dict(zip(names, w))
    return {r["doc_id"]: float(sigmoid(sum(weight.get(a, 0.0) for a in markers_of(r["text"])) - theta[0])) for r in docs}


# --- language: grams counted one by one ------------------------------------------------------------------------


def grams(text, bins):
    out = np.zeros(bins)
    c = [ord(x) for x in text.lower()]
    m = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
    wrap = 0xFFFFFFFF
    one = [a * m[0] & wrap for a in c]
    two = [((a ^ (b + m[3] & wrap)) * m[1]) & wrap for a, b in zip(one, c[1:])]
    three = [((a ^ (b + m[3] & wrap)) * m[2]) & wrap for a, b in zip(two, c[2:])]
    for hashes in (one, two, three):
        for h, n in Counter(h >> 19 for h in hashes).items():
            out[h] += n / max(1, len(hashes))
    return np.sqrt(out)


def languages(docs, codewords, bins, steps=120):
    """id -> (language, share) of texts with a letter, by dense logistic fits of all bits of the codewords."""
    rows = [r for r in docs if r["lang"] is not None and r["text"] and any(ch.isalpha() for ch in r["text"]) and fold(r["doc_id"]) != 2]
    names = sorted({r["lang"] for r in rows})
    code = codewords(len(names))
    x = np.array([np.append(grams(r["text"], bins), 1) for r in rows])
    y = code[[names.index(r["lang"]) for r in rows]]
    seen = Counter(r["lang"] for r in rows)
    weight = np.array([len(rows) / len(names) / seen[r["lang"]] for r in rows])
    step = 4 / (weight * (x**2).sum(1)).mean()
    w = z = np.zeros((bins + 1, code.shape[1]))
    momentum = 1.0
    for _ in range(steps):
        grad = -(x.T @ (weight[:, None] * y * sigmoid(-y * (x @ z)))) / len(x) + 1e-6 * z
        new = z - step * grad
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    right = ((x @ w) * y > 0).mean(0).clip(0.5, 0.999)
    bit = np.log(right / (1 - right))
    bit = bit / bit.sum() * code.shape[1]
    out = {}
    for r in docs:
        if r["text"] and any(ch.isalpha() for ch in r["text"]):
            margin = np.append(grams(r["text"], bins), 1) @ w
            loss = np.array([(bit * np.log1p(np.exp(-margin * c))).sum() for c in code])
            p = np.exp(loss.min() - loss)
            out[r["doc_id"]] = names[int(loss.argmin())], float(p.max() / p.sum())
    return out


# --- quality: one least-squares fit ----------------------------------------------------------------------------


def rising(x, y):
    """The least-squares rising fit: of each point the greatest over its starts of the least over its ends of the means."""
    order = np.argsort(x, kind="stable")
    x, y, n = x[order], y[order], len(x)
    total = np.concatenate([[0], np.cumsum(y)])
    fit = []
    for i in range(n):
        starts, ends = np.arange(i + 1), np.arange(i + 1, n + 1)
        fit.append(((total[ends][None, :] - total[starts][:, None]) / (ends[None, :] - starts[:, None])).min(1).max())
    fit = np.array(fit).round(12)
    blocks = [np.flatnonzero(fit == v) for v in np.unique(fit)]
    return np.array([x[b].mean() for b in blocks]), np.array([fit[b[0]] for b in blocks])


def quality_scores(docs, labels, statistics, n_features=160, seed=7):
    rows = labelled(docs, labels, "quality")
    raw = np.array([statistics(t) for _, t, _ in rows])
    y = np.array([float(v) for _, _, v in rows])
    held = np.array([int(hashlib.md5(f"c{i}".encode()).hexdigest()[:4], 16) % 4 == 0 for i, _, _ in rows])
    centre, scale = raw.mean(0), raw.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    turns, phases = rng.normal(0, 0.35, (raw.shape[1], n_features)), rng.uniform(0, 2 * np.pi, n_features)
    phi = lambda s: np.hstack([np.sqrt(2 / n_features) * np.cos(np.clip((s - centre) / scale, -8, 8) @ turns + phases), np.ones((len(s), 1))])
    a = phi(raw[~held])
    w = np.linalg.solve(a.T @ a + 1e-2 * np.eye(a.shape[1]), a.T @ y[~held])
    knots = rising(phi(raw[held]) @ w, y[held])
    score = np.interp(phi(np.array([statistics(r["text"]) for r in docs])) @ w, *knots).clip(0, 1)
    return {r["doc_id"]: float(s) for r, s in zip(docs, score)}


# --- the pipeline's other stages -------------------------------------------------------------------------------


def words(text):
    return [x for x in WORD.split(text or "") if x]


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def groups(docs, width, percent):
    """id -> least id of its group, over all pairs; ids are unique here."""
    sets = {}
    for r in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(r["text"])]
        sets[r["doc_id"]] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    at = {}
    for i in ids:
        for s in sets[i]:
            at.setdefault(s, []).append(i)
    common = Counter((a, b) for members in at.values() for k, b in enumerate(members) for a in members[:k])
    edges = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return components(ids, edges)


def copies(docs, weights=(5, 2, 1), share=1.5, most=2):
    """id -> how often the mix takes it: targets by filling up source by source, documents in the order of md5 of their ids."""
    sizes = {r["doc_id"]: len(words(r["text"])) for r in docs}
    names = sorted({r["source"] for r in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[r["doc_id"]] for r in docs if r["source"] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, unfilled = share * sum(total.values()), {}, set(names)
    while unfilled:
        level = left / sum(weight[s] for s in unfilled)
        full = {s for s in unfilled if level * weight[s] >= most * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in unfilled}
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        unfilled -= full
    out = Counter()
    for s in names:
        done = 0
        mine = sorted((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]) for r in docs if r["source"] == s)
        for _, i in mine * most:
            if sizes[i] and done + sizes[i] / 2 < target[s]:
                out[i] += 1
            done += sizes[i]
    return out
