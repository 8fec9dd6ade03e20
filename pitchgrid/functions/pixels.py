"""Pixel leaves in numpy: small helpers that run on one frame inside an Arrow batch.

Pictures are height x width x 3 uint8 RGB, masks height x width bool, polygons lists of (n, 2) arrays of x, y.
"""

from __future__ import annotations

import numpy as np

# Linear sRGB to XYZ (D65), and the two matrices of Oklab
RGB_TO_XYZ = np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]])
XYZ_TO_LMS = np.array([[0.8189330101, 0.3618667424, -0.1288597137], [0.0329845436, 0.9293118715, 0.0361456387], [0.0482003018, 0.2643662691, 0.6338517070]])
LMS_TO_LAB = np.array([[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]])
WHITE = RGB_TO_XYZ.sum(axis=1)

#: Channels and upper limits of the histogram types; hue goes to 180, all else to 256.
HISTOGRAMS = {
    "rgb": ("rgb", (0, 1, 2), (256, 256, 256)), "hsv": ("hsv", (0, 1, 2), (180, 256, 256)), "hs": ("hsv", (0, 1), (180, 256)),
    "lab": ("lab", (0, 1, 2), (256, 256, 256)), "ab": ("lab", (1, 2), (256, 256)), "oklab": ("oklab", (1, 2), (256, 256)),
}


def to_hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue 0-179, saturation and value 0-255."""
    x = rgb.astype(float)
    top, low = x.max(axis=-1), x.min(axis=-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = np.moveaxis(x, -1, 0)
    hue = np.select([top == low, top == r, top == g], [0, (g - b) / span, 2 + (b - r) / span], 4 + (r - g) / span) * 60 % 360
    return np.stack([np.round(hue / 2) % 180, np.round(255 * (top - low) / np.where(top > 0, top, 1)), top], axis=-1).astype(np.uint8)


def _linear(rgb: np.ndarray) -> np.ndarray:
    x = rgb / 255.0
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab scaled to bytes."""
    t = _linear(rgb) @ RGB_TO_XYZ.T / WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    x, y, z = np.moveaxis(f, -1, 0)
    lab = np.stack([(116 * y - 16) * 255 / 100, 500 * (x - y) + 128, 200 * (y - z) + 128], axis=-1)
    return np.clip(np.round(lab), 0, 255).astype(np.uint8)


def to_oklab(rgb: np.ndarray) -> np.ndarray:
    """Oklab scaled to bytes, each colour channel from its own axis."""
    lab = np.cbrt(_linear(rgb) @ RGB_TO_XYZ.T @ XYZ_TO_LMS.T) @ LMS_TO_LAB.T
    return np.clip(lab * [100, 127, 127] + [0, 127, 127], 0, 255).astype(np.uint8)


SPACES = {"rgb": lambda x: x, "hsv": to_hsv, "lab": to_lab, "oklab": to_oklab}


def colour_histogram(rgb: np.ndarray, mask: np.ndarray, kind: str = "ab", bins: int = 8) -> np.ndarray | None:
    """Joint histogram of the masked pixels, summing to 1; zeros for an empty mask, None for an unknown kind."""
    if kind not in HISTOGRAMS:
        return None
    space, channels, limits = HISTOGRAMS[kind]
    pixels = SPACES[space](rgb)[mask].astype(np.int64)
    flat = np.zeros(len(pixels), np.int64)
    for c, limit in zip(channels, limits, strict=True):
        flat = flat * bins + np.minimum(pixels[:, c] * bins // limit, bins - 1)
    counts = np.bincount(flat, minlength=bins ** len(channels)).astype(np.float32)
    return counts / max(counts.sum(), 1)


def fill(polygons: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Mask of the pixels in any polygon (even-odd by row, edges included), what overflows clipped."""
    out = np.zeros(shape, bool)
    for poly in polygons:
        p = np.asarray(poly, float)
        if not len(p):
            continue
        q = np.roll(p, -1, axis=0)
        for y in range(max(0, int(np.ceil(p[:, 1].min()))), min(shape[0] - 1, int(np.floor(p[:, 1].max()))) + 1):
            level = p[:, 1] == q[:, 1]
            hit = ((p[:, 1] <= y) != (q[:, 1] <= y)) & ~level
            xs = np.sort(p[hit, 0] + (y - p[hit, 1]) * (q[hit, 0] - p[hit, 0]) / (q[hit, 1] - p[hit, 1]))
            spans = [*zip(xs[::2], xs[1::2], strict=False), *[(min(a, b), max(a, b)) for a, b in zip(p[level & (p[:, 1] == y), 0], q[level & (p[:, 1] == y), 0], strict=True)]]
            for a, b in spans:
                out[y, max(0, int(np.ceil(a))) : max(0, int(np.floor(b)) + 1)] = True
    return out


def paint(image: np.ndarray, polygons: list[np.ndarray], value) -> np.ndarray:
    """image with the polygons set to value, what overflows clamped to the edge."""
    high = np.array(image.shape[1::-1]) - 1
    out = image.copy()
    out[fill([np.clip(p, 0, high) for p in polygons], image.shape[:2])] = value
    return out


def indices(polygons: list[np.ndarray], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all polygons' pixels, one polygon after the other; overlaps appear more than once."""
    found = [np.nonzero(fill([p], shape)) for p in polygons]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def patch(image: np.ndarray, box, copy: bool = True) -> np.ndarray:
    """The half-open cut of a box, a view if not copied."""
    x1, y1, x2, y2 = (int(v) for v in box)
    out = image[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
    return out.copy() if copy else out


def disk(radius: int) -> np.ndarray:
    y, x = np.ogrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def dilate(mask: np.ndarray, element: np.ndarray, mirrored: bool = False) -> np.ndarray:
    h, w = element.shape[0] // 2, element.shape[1] // 2
    padded, out = np.pad(mask, ((h, h), (w, w))), np.zeros_like(mask)
    for dy, dx in zip(*np.nonzero(element), strict=True):
        dy, dx = (2 * h - dy, 2 * w - dx) if mirrored else (dy, dx)
        out |= padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def ellipse(size: int) -> np.ndarray:
    """The filled ellipse in a square of even or odd size around its middle pixel, as wide in each row as the circle of half the size is."""
    r = size // 2
    y = np.arange(size) - r
    reach = np.rint(np.sqrt(np.maximum(r * r - y * y, 0)))[:, None]
    return np.abs(np.arange(size) - r)[None, :] <= reach


def erode(mask: np.ndarray, element: np.ndarray, beyond: bool = False) -> np.ndarray:
    """beyond: what the picture's outside counts as."""
    h, w = element.shape
    return ~dilate(~np.pad(mask, ((h, h), (w, w)), constant_values=beyond), element, mirrored=True)[h:-h, w:-w]


def opened(mask: np.ndarray, element: np.ndarray, beyond: bool = False) -> np.ndarray:
    return dilate(erode(mask, element, beyond), element)


def half(mask: np.ndarray, part: str = "all") -> np.ndarray:
    """The mask's upper or lower half of rows, or all of it."""
    out, middle = mask.copy(), mask.shape[0] // 2
    if part == "upper":
        out[middle:] = False
    elif part == "lower":
        out[:middle] = False
    return out


def body_histogram(rgb: np.ndarray, polygons: list[np.ndarray], radius: int = 2, part: str = "all", kind: str = "ab") -> np.ndarray | None:
    """Histogram of a person's pixels, the mask's edge and the other half left out."""
    return colour_histogram(rgb, half(erode(fill(polygons, rgb.shape[:2]), disk(radius)), part), kind)


def lloyd(points: np.ndarray, k: int, rounds: int = 30, fit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of k-means, started on evenly spaced sorted points; fitted on fit if given."""
    x = points if fit is None else fit
    order = np.lexsort(x.T[::-1])
    centres = x[order[np.linspace(0, len(x) - 1, k).astype(int)]].astype(float)
    nearest = lambda p: ((p[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        label = nearest(x)
        new = np.array([x[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return nearest(points), centres


def labelled(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """0 outside the mask, else the number of the pixel's part from 1 on, in order of first pixels. Rows' runs are merged with those above."""
    parent, runs, above = [], [], []
    reach = 1 if diagonal else 0

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0))
        here, at = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            while at < len(above) and above[at][1] + reach <= a:
                at += 1
            for c, _, other in above[at:]:
                if c - reach >= b:
                    break
                one, two = sorted((root(k), root(other)))
                parent[two] = one
            here.append((a, b, k))
            runs.append((y, a, b, k))
        above = here
    names, out = {}, np.zeros(mask.shape, int)
    for y, a, b, k in runs:
        out[y, a:b] = names.setdefault(root(k), len(names) + 1)
    return out


def components(mask: np.ndarray) -> list[np.ndarray]:
    """The 4-connected parts of a mask, in order of their first pixel."""
    label = labelled(mask)
    return [label == k for k in range(1, label.max(initial=0) + 1)]


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines (x, y) of a mask's parts, along pixel edges, by following each boundary with the part on its right."""
    out = []
    for part in components(mask):
        p = np.pad(part, 1)
        steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for y, x in zip(*np.nonzero(part), strict=True):
            inside = p[y : y + 3, x : x + 3]
            for outer, a, b in ((inside[0, 1], (x, y), (x + 1, y)), (inside[1, 2], (x + 1, y), (x + 1, y + 1)), (inside[2, 1], (x + 1, y + 1), (x, y + 1)), (inside[1, 0], (x, y + 1), (x, y))):
                if not outer:
                    steps.setdefault((int(a[0]), int(a[1])), []).append((int(b[0]), int(b[1])))
        start = min(steps, key=lambda s: (s[1], s[0]))
        line, at = [start], steps[start].pop()
        while at != start:
            line.append(at)
            at = steps[at].pop()
        out.append(np.array(line))
    return out


def resized(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The nearest pixels on a grid of the given shape."""
    rows = np.minimum((np.arange(shape[0]) + 0.5) * image.shape[0] / shape[0], image.shape[0] - 1).astype(int)
    columns = np.minimum((np.arange(shape[1]) + 0.5) * image.shape[1] / shape[1], image.shape[1] - 1).astype(int)
    return image[rows][:, columns]


def with_borders(flow: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """Flow padded with zeros to the size of the whole picture."""
    return np.pad(flow, [(top, bottom), (left, right)] + [(0, 0)] * (flow.ndim - 2))


def without_borders(mask: np.ndarray, shape: tuple[int, int], top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """A mask resized to the flow's whole size, its borders blank; a border of 0 blanks nothing."""
    out = resized(mask, shape).copy()
    out[:top], out[shape[0] - bottom :], out[:, :left], out[:, shape[1] - right :] = 0, 0, 0, 0
    return out


def dequantized(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Flow of two byte pictures."""
    return np.stack([(c.astype(np.float32) - 128) / np.float32(127.999) for c in (u, v)], axis=-1)


def filled(part: np.ndarray) -> np.ndarray:
    """A part with its holes."""
    outside = labelled(~np.pad(part, 1))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def outline(part: np.ndarray) -> np.ndarray:
    """(x, y) of a filled part's pixels that have a neighbour outside."""
    p = np.pad(part, 1)
    inside = p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return np.argwhere(part & ~inside)[:, ::-1]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of integer points, in order round it."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p)

    def chain(ordered: list) -> list:
        out: list = []
        for q in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def large_hulls(mask: np.ndarray, min_share: float) -> np.ndarray:
    """mask within the hulls of its large parts: those whose outline through pixel centres has an area of (min_share times the longer side) squared.

    A part's outline with b pixels encloses n - b / 2 - 1 if n pixels lie on or in it (Pick's theorem).
    """
    keep, least = np.zeros(mask.shape, bool), (min_share * max(mask.shape)) ** 2
    label = labelled(mask, diagonal=True)
    for k in range(1, label.max(initial=0) + 1):
        ys, xs = np.nonzero(label == k)
        height, width = int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1
        if height * width >= least:
            part = filled(label[ys.min() : ys.min() + height, xs.min() : xs.min() + width] == k)
            border = outline(part)
            if part.sum() - len(border) / 2 - 1 >= least:
                keep |= fill([hull(border) + [xs.min(), ys.min()]], mask.shape)
    return mask & keep


def field_mask(
    rgb: np.ndarray, people: list[tuple[list[int], list[np.ndarray]]], overlays: list[tuple[list[int], np.ndarray, np.ndarray]] = (), clusters: int = 5,
    rounds: int = 30, max_difference: float = 0.011, max_error: float = 0.01, open_size: int = 8, min_share: float = 0.15,
) -> np.ndarray:
    """The field: the largest colour class and those near it, cleaned.

    people are boxes with polygons inside them, overlays boxes with a mask and a mean patch. People are painted black, and so
    is an overlay that the picture shows; these pixels are clustered like the others. Classes join from the largest to the
    smallest, each compared with the running mean colour in doubles. The classes are fitted on half of the pixels.
    """
    rgb = rgb.copy()
    for box, mask, mean in overlays:
        cut = patch(rgb, box, copy=False)
        if cut.shape == mean.shape and (((np.where(mask[..., None], cut, 0).astype(float) - mean) ** 2).mean() / 65025) <= max_difference:
            cut[mask] = 0
    for box, polygons in people:
        cut = patch(rgb, box, copy=False)
        if cut.size:
            cut[...] = paint(cut, polygons, 0)
    points = rgb.reshape(-1, 3).astype(float)
    sample = np.linspace(0, len(points) - 1, max(len(points) // 2, 1)).astype(int)
    label, centres = lloyd(points, clusters, rounds, points[sample])
    order = np.argsort(-np.bincount(label[sample], minlength=clusters), kind="stable")
    centres = np.floor(centres)
    colour, chosen = centres[order[0]], [order[0]]
    for c in order[1:]:
        if ((centres[c] - colour) ** 2).mean() / 65025 < max_error:
            chosen.append(c)
            colour = (colour + centres[c]) / 2
    return large_hulls(opened(np.isin(label, chosen).reshape(rgb.shape[:2]), ellipse(open_size), beyond=True), min_share)


def moments(vectors: np.ndarray) -> list[float]:
    """Sums of u*u, v*v, u*v, the count, and counts of u and v in [0, 1] and in [-1, 0), in the order that ``orientation`` takes them."""
    u, v = vectors.astype(float).reshape(-1, 2).T
    up, down = (lambda x: int(((x >= 0) & (x <= 1)).sum())), (lambda x: int(((x >= -1) & (x < 0)).sum()))
    return [float(u @ u), float(v @ v), float(u @ v), float(len(u)), up(u), down(u), up(v), down(v)]


def scaled_person(box: list[float], polygons: list[np.ndarray], scale: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A box scaled and truncated, and the polygons inside it scaled by what has become of its sides."""
    box = np.asarray(box, float)
    out = (np.tile(scale, 2) * box).astype(int)
    sides = np.maximum(box[2:] - box[:2], 1)
    return out, [((out[2:] - out[:2]) / sides * p).astype(int) for p in polygons]
