"""Dense numerical kernels on numpy, without Spark. Each is called once for a key's data, inside a grouped map."""

from __future__ import annotations

import numpy as np


# --- filters -------------------------------------------------------------------------------------------------------------------


def butter_bandpass(low: float, high: float, fs: float = 1.0, order: int = 4, kind: str = "bandpass") -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter (band-pass, low-pass or high-pass), by the bilinear transform."""
    if not 0 < (low if kind != "lowpass" else high) <= (high if kind != "highpass" else low) < fs / 2:
        raise ValueError("edges must rise and lie between 0 and half the sampling rate")
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 4.0 * np.tan(np.pi * f / fs)  # noqa: E731  for a sampling rate of 2
    if kind == "lowpass":
        w = warp(high)
        zeros, poles, gain = np.zeros(0, complex), poles * w, w**order
    elif kind == "highpass":
        w = warp(low)
        zeros, gain = np.zeros(order, complex), float(np.real(1 / np.prod(-poles)))
        poles = w / poles
    else:
        width, centre = warp(high) - warp(low), np.sqrt(warp(low) * warp(high))
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        zeros, poles, gain = np.zeros(order, complex), np.r_[half + root, half - root], width**order
    excess = len(poles) - len(zeros)
    gain = gain * np.real(np.prod(4.0 - zeros) / np.prod(4.0 - poles))
    zeros, poles = np.r_[(4.0 + zeros) / (4.0 - zeros), -np.ones(excess)], (4.0 + poles) / (4.0 - poles)
    return np.real(gain * np.poly(zeros)), np.real(np.poly(poles))


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state that a constant input of 1 leaves unchanged."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filter along the last axis, from the given state (one for each series), in transposed direct form."""
    y, z = np.empty_like(x), state.copy()
    for t in range(x.shape[-1]):
        now = x[..., t]
        out = b[0] * now + z[..., 0]
        z[..., :-1] = z[..., 1:] + b[1:-1] * now[..., None] - a[1:-1] * out[..., None]
        z[..., -1] = b[-1] * now - a[-1] * out
        y[..., t] = out
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd padding of three times the number of taps: no phase shift."""
    x = np.atleast_2d(np.asarray(x, float))
    pad = 3 * max(len(a), len(b))
    if x.shape[-1] <= pad:
        raise ValueError(f"series must be longer than {pad} samples")
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    rest = steady_state(b, a)
    y = lfilter(b, a, wide, rest * wide[:, :1])[:, ::-1]
    y = lfilter(b, a, y, rest * y[:, :1])[:, ::-1]
    return y[:, pad:-pad]


def band_filter(x: np.ndarray, low: float, high: float, fs: float = 1.0, order: int = 4, kind: str = "bandpass") -> np.ndarray:
    """Zero-phase Butterworth filter of series (rows)."""
    return filtfilt(*butter_bandpass(low, high, fs, order, kind), x)


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal along the last axis."""
    n = x.shape[-1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * weight, axis=-1)


def hilbert_frequency(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Instantaneous phase (in [0, 2 pi)), frequency and amplitude."""
    z = analytic(x)
    phase = np.unwrap(np.angle(z), axis=-1)
    return np.mod(phase, 2 * np.pi), np.gradient(phase, axis=-1) * fs / (2 * np.pi), np.abs(z)


def _envelope(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through x at the given places, mirrored once at both ends."""
    n = len(x)
    t = np.r_[-at[0], at, 2 * (n - 1) - at[-1]].astype(float)
    v = np.r_[x[at[0]], x[at], x[at[-1]]]
    keep = np.r_[True, np.diff(t) > 0]
    t, v = t[keep], v[keep]
    if len(t) < 3:
        return np.interp(np.arange(n), t, v)
    h, slope = np.diff(t), np.diff(v) / np.diff(t)
    m = np.zeros((len(t), len(t)))
    m[0, 0] = m[-1, -1] = 1
    right = np.zeros(len(t))
    for i in range(1, len(t) - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i] = 6 * (slope[i] - slope[i - 1])
    c = np.linalg.solve(m, right)
    q = np.arange(n)
    i = np.clip(np.searchsorted(t, q, "right") - 1, 0, len(h) - 1)
    a, b = t[i + 1] - q, q - t[i]
    return (c[i] * a**3 + c[i + 1] * b**3) / (6 * h[i]) + (v[i] / h[i] - c[i] * h[i] / 6) * a + (v[i + 1] / h[i] - c[i + 1] * h[i] / 6) * b


def sift(x: np.ndarray, most: int = 10, stop: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Empirical mode decomposition, [mode, t]; the last row is what is left, and rows sum to x.

    A mode is sifted until its envelopes' mean has less than `stop` of its root mean square, or `rounds` times.
    """
    rest, modes = np.asarray(x, float).copy(), []
    for _ in range(most):
        h = rest.copy()
        for _ in range(rounds):
            d = np.diff(h)
            high = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            low = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(high) < 2 or len(low) < 2:
                break
            mean = (_envelope(h, high) + _envelope(h, low)) / 2
            h = h - mean
            if np.sqrt(np.mean(mean**2)) < stop * np.sqrt(np.mean(h**2)):
                break
        else:
            pass
        d = np.diff(rest)
        if np.count_nonzero(d[:-1] * d[1:] < 0) < 3:
            break
        modes.append(h)
        rest = rest - h
    return np.array([*modes, rest])


# --- graphs --------------------------------------------------------------------------------------------------------------------


class Joined:
    """Union-find over 0 .. n - 1 that knows sizes and edge counts of sets."""

    def __init__(self, n: int):
        self.up, self.size, self.edges = list(range(n)), [1] * n, [0] * n

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> int:
        a, b = self.top(a), self.top(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]
            self.edges[a] += self.edges[b]
        self.edges[a] += 1
        return a


def weak_labels(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, directions ignored. nodes: sorted."""
    sets = Joined(len(nodes))
    for a, b in zip(np.searchsorted(nodes, src).tolist(), np.searchsorted(nodes, dst).tolist(), strict=True):
        sets.join(a, b)
    tops = np.array([sets.top(i) for i in range(len(nodes))], int)
    least: dict[int, int] = {}
    for i, t in enumerate(tops.tolist()):
        least.setdefault(t, i)
    return nodes[[least[t] for t in tops.tolist()]] if len(nodes) else nodes


def strong_labels(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Smallest node of each node's strongly connected component, by two depth-first passes. nodes: sorted."""
    n = len(nodes)
    a, b = np.searchsorted(nodes, src).tolist(), np.searchsorted(nodes, dst).tolist()
    ahead, behind = [[] for _ in range(n)], [[] for _ in range(n)]
    for x, y in zip(a, b, strict=True):
        ahead[x].append(y)
        behind[y].append(x)
    done, order = [False] * n, []
    for root in range(n):
        if done[root]:
            continue
        done[root], path = True, [(root, iter(ahead[root]))]
        while path:
            node, rest = path[-1]
            for y in rest:
                if not done[y]:
                    done[y] = True
                    path.append((y, iter(ahead[y])))
                    break
            else:
                order.append(node)
                path.pop()
    label = [-1] * n
    for root in reversed(order):
        if label[root] >= 0:
            continue
        members, label[root] = [root], root
        for x in members:
            for y in behind[x]:
                if label[y] < 0:
                    label[y] = root
                    members.append(y)
        for x in members:
            label[x] = min(members)
    return nodes[label] if n else nodes


def percolation(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of edges and of nodes in the giant component when edges of at least each threshold stay. One sweep from heavy to light.

    Of components of one size the one with the smallest node counts, as in the component operators. Without an edge both shares are 0.
    """
    order = np.argsort(-weight, kind="stable")
    a, b, w = src[order].tolist(), dst[order].tolist(), weight[order]
    upto = np.searchsorted(-w, -grid, "right")
    sets, least = Joined(n), list(range(n))
    edges, share, done = np.zeros(len(grid)), np.zeros(len(grid)), 0
    best = (1, 0)  # size and, negative, the smallest node
    for g in np.argsort(-grid, kind="stable"):
        for i in range(done, upto[g]):
            x, y = sets.top(a[i]), sets.top(b[i])
            low = min(least[x], least[y])
            t = sets.join(x, y)
            least[t] = low
            best = max(best, (sets.size[t], -low))
        done = max(done, int(upto[g]))
        if done:
            edges[g] = sets.edges[sets.top(-best[1])] / len(w)
            share[g] = best[0] / n
    return edges, share


def dense_laplacian(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Degrees less weights; nodes sorted, edges once each."""
    a, b = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    m = np.zeros((len(nodes), len(nodes)))
    np.add.at(m, (a, b), -weight)
    other = a != b
    np.add.at(m, (b[other], a[other]), -weight[other])
    m[np.diag_indices_from(m)] -= m.sum(axis=1)
    return m


def density(tau: float, laplacian: np.ndarray) -> np.ndarray:
    """exp(-tau L) over its trace, by scaling and squaring of a matrix without negative entries, so that none turns negative."""
    n = len(laplacian)
    if not n:
        return laplacian
    shift = max(float(np.max(np.diag(laplacian))), 0.0)
    m = tau * (shift * np.eye(n) - laplacian)
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(m).sum(axis=1).max(), 1e-300)))) + 1)
    m = m / 2.0**squarings
    total, term = np.eye(n), np.eye(n)
    for k in range(1, 19):
        term = term @ m / k
        total = total + term
    total /= np.trace(total)
    for _ in range(squarings):
        total = total @ total
        total /= np.trace(total)
    return (total + total.T) / 2


# --- clustering ----------------------------------------------------------------------------------------------------------------


def linkage(distance: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows (a, b, height, size) of agglomerative clustering of a square distance matrix: single, complete, average or ward.

    New clusters are numbered n, n + 1, ...; in each row a < b, and of equal heights the pair that was first found by chains goes first.
    """
    if method not in ("single", "complete", "average", "ward"):
        raise ValueError(f"unknown method: {method}")
    d = np.array(distance, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    alive, size = np.ones(n, bool), np.ones(n)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        chain.pop(), chain.pop()
        x, y = min(x, y), max(x, y)
        height = d[x, y]
        merges.append((x, y, height))
        if method == "single":
            new = np.minimum(d[x], d[y])
        elif method == "complete":
            new = np.maximum(d[x], d[y])
        elif method == "average":
            new = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
        else:
            with np.errstate(invalid="ignore"):
                total = size[x] + size[y] + size
                new = np.sqrt(np.maximum(0, ((size[x] + size) * d[x] ** 2 + (size[y] + size) * d[y] ** 2 - size * height**2) / total))
        size[y] += size[x]
        alive[x] = False
        d[y] = new
        d[:, y] = new
        d[y, y] = np.inf
        d[x] = d[:, x] = np.inf
    # by height, with the numbers that this order gives
    order = sorted(range(n - 1), key=lambda i: merges[i][2])
    sets, number, out = Joined(n), list(range(n)), np.zeros((max(0, n - 1), 4))
    for step, i in enumerate(order):
        x, y, height = merges[i]
        a, b = number[sets.top(x)], number[sets.top(y)]
        t = sets.join(x, y)
        number[t] = n + step
        out[step] = min(a, b), max(a, b), height, sets.size[t]
    return out


def leaves(z: np.ndarray) -> list[int]:
    """Leaves from left to right: of each merge the first cluster, then the second."""
    n = len(z) + 1
    out, path = [], [2 * n - 2]
    while path:
        x = path.pop()
        if x < n:
            out.append(x)
        else:
            path += [int(z[x - n, 1]), int(z[x - n, 0])]
    return out


def flat_clusters(z: np.ndarray, height: float) -> np.ndarray:
    """Label (from 1) of each leaf: merges up to the height hold.

    Labels go through the tree with inner clusters first (first cluster before second), then the leaves that hang on the merge itself.
    """
    n = len(z) + 1
    label, count = np.zeros(n, int), 0
    if n == 1:
        return label + 1
    top = z[:, 2].copy()  # the largest height below each merge
    for i in range(len(z)):
        for c in z[i, :2].astype(int):
            if c >= n:
                top[i] = max(top[i], top[c - n])
    path = [(2 * n - 2, 0, False)]
    while path:
        x, own, back = path.pop()
        a, b = (int(c) for c in z[x - n, :2])
        if not back:
            if not own and top[x - n] <= height:
                count += 1
                own = count
            path.append((x, own, True))
            path += [(c, own, False) for c in (b, a) if c >= n]
        else:
            for c in (a, b):
                if c < n:
                    if not own:
                        count += 1
                    label[c] = own or count
    return label
