"""Helpers of these tests."""


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def least_roots(nodes, links):
    """The least node that each one reaches, by plain union-find."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
