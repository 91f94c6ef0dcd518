"""Slow, plain versions that tests compare with."""
import math


def plain_boosting(bins, y, rounds, depth, step, least, l2, weight):
    """Margins of second-order boosting on binned rows, row by row and cut by cut."""
    n = len(y)
    w = [weight if t else 1.0 for t in y]
    share = sum(a for a, t in zip(w, y) if t) / sum(w)
    margin = [math.log(share / (1 - share))] * n

    def best(rows, g, h):
        all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
        top = (1e-9, None)
        for f in range(bins.shape[1]):
            for c in range(int(bins[:, f].max())):
                left = [i for i in rows if bins[i, f] <= c]
                lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                if lh < least or all_h - lh < least:
                    continue
                gain = lg ** 2 / (lh + l2) + (all_g - lg) ** 2 / (all_h - lh + l2) - all_g ** 2 / (all_h + l2)
                if gain > top[0] + 1e-12:
                    top = (gain, (f, c))
        return top[1]

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a * (q - t) for a, q, t in zip(w, p, y)], [a * q * (1 - q) for a, q in zip(w, p)]
        nodes = [list(range(n))]
        for _ in range(depth):
            deeper = []
            for rows in nodes:
                cut = best(rows, g, h) if rows else None
                if cut is None:
                    deeper.append(rows)
                else:
                    deeper.append([i for i in rows if bins[i, cut[0]] <= cut[1]])
                    deeper.append([i for i in rows if bins[i, cut[0]] > cut[1]])
            nodes = deeper
        for rows in nodes:
            if rows:
                leaf = -sum(g[i] for i in rows) / (sum(h[i] for i in rows) + l2) * step
                for i in rows:
                    margin[i] += leaf
    return margin


def plain_isotonic(points):
    """Isotonic values of (score, label) rows: largest of the smallest means, score by score."""
    scores = sorted({s for s, _ in points})
    n = [sum(1 for s, _ in points if s == t) for t in scores]
    p = [sum(y for s, y in points if s == t) for t in scores]
    out = {}
    for i, t in enumerate(scores):
        out[t] = max(min(sum(p[a:b + 1]) / sum(n[a:b + 1]) for b in range(i, len(scores))) for a in range(i + 1))
    return out
