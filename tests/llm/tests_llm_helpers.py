"""Brute-force versions shared by tests."""

import collections


def brute_spans(texts, length):
    raws, count = [t.encode() for t in texts], collections.Counter()
    for b in raws:
        count.update(hash(b[p : p + length]) for p in range(len(b) - length + 1))
    out = []
    for b in raws:
        spans = []
        for p in range(len(b) - length + 1):
            if count[hash(b[p : p + length])] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out.append([tuple(s) for s in spans])
    return out
