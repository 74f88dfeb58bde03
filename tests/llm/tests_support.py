"""Brute-force helpers."""


def roots(links, nodes):
    """The smallest node that each node reaches."""
    p = {n: n for n in nodes}

    def find(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
