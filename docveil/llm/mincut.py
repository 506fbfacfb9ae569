"""Two-label minimum cuts of small graphs."""

from __future__ import annotations

from collections import deque

EPS = 1e-12


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of what wrong labels cost and of cut edges.

    gain[i] > 0: label False costs so much; gain[i] < 0: label True costs -gain[i].
    A node whose gain outweighs all its edges has its sign in some optimum, so it is
    settled and its edges become gains of its neighbours; what is left goes to max-flow.
    Of equal cuts the one with fewer True labels is taken.
    """
    n = len(gain)
    gain, label = list(gain), [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        weight = sum(w for j, w in near[i].items() if label[j] is None)
        if label[i] is None and (gain[i] > weight or -gain[i] >= weight):
            label[i] = gain[i] > weight
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    todo.append(j)
    core = [i for i in range(n) if label[i] is None]
    if core:
        for i in _reached(core, gain, near):
            label[i] = True
    return [bool(x) for x in label]


def _reached(core: list[int], gain: list[float], near: list[dict[int, float]]) -> list[int]:
    """Nodes on the source's side of a minimum cut, by blocking flows in level graphs."""
    at = {i: k for k, i in enumerate(core)}
    source, sink = len(core), len(core) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(core) + 2)]
    for i, k in at.items():
        if gain[i] > 0:
            room[source][k] = gain[i]
            room[k].setdefault(source, 0.0)
        else:
            room[k][sink] = -gain[i]
            room[sink].setdefault(k, 0.0)
        for j, w in near[i].items():
            if j in at:
                room[k][at[j]] = w
    while True:
        depth = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > EPS and v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        if sink not in depth:
            return [i for i, k in at.items() if k in depth]
        ways = [iter(list(r)) for r in room]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(room[a][b] for a, b in steps)
                full = None
                for k, (a, b) in enumerate(steps):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if full is None and room[a][b] <= EPS:
                        full = k
                for a in path[full + 1 :]:
                    ways[a] = iter(list(room[a]))
                del path[full + 1 :]
                continue
            for v in ways[u]:
                if room[u].get(v, 0.0) > EPS and depth.get(v) == depth[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                depth[u] = -1
