"""Parsers of scan files: bytes to arrays. Pure functions that tasks run on whole
files; text formats that split by line are read by Spark instead (readers.py)."""

from __future__ import annotations

import numpy as np

# Scalar types of PLY headers.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2",
             "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4",
             "double": "f8", "float64": "f8"}


def _header(data: bytes):
    end = data.index(b"end_header")
    start = data.index(b"\n", end) + 1
    form, elements = None, []
    for line in data[:end].decode("latin-1").split("\n"):
        w = line.split()
        if not w or w[0] in ("ply", "comment", "obj_info"):
            continue
        if w[0] == "format":
            form = w[1]
        elif w[0] == "element":
            elements.append((w[1], int(w[2]), []))
        elif w[0] == "property":
            elements[-1][2].append((w[-1], ("list", w[2], w[3]) if w[1] == "list" else (w[1],)))
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown PLY format {form}")
    return form, elements, start


def parse_ply(data: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Vertex properties by name, and triangles (n, 3). Faces that aren't triangles
    are an error."""
    form, elements, at = _header(data)
    vertices: dict[str, np.ndarray] = {}
    faces = np.empty((0, 3), np.int64)
    tokens, pos = (data[at:].split(), 0) if form == "ascii" else ([], 0)
    order = ">" if form == "binary_big_endian" else "<"
    for name, count, props in elements:
        lists = [p for p in props if p[1][0] == "list"]
        if form == "ascii":
            if not lists:
                table = np.array(tokens[pos:pos + count * len(props)], float).reshape(count, len(props))
                pos += count * len(props)
                if name == "vertex":
                    vertices = {p[0]: table[:, i] for i, p in enumerate(props)}
                continue
            rows = []
            for _ in range(count):
                for key, kind in props:
                    if kind[0] == "list":
                        n = int(tokens[pos])
                        if key in ("vertex_index", "vertex_indices"):
                            rows.append([int(t) for t in tokens[pos + 1:pos + 1 + n]])
                        pos += 1 + n
                    else:
                        pos += 1
        else:
            if not lists:
                kind = np.dtype([(p[0], order + PLY_TYPES[p[1][0]]) for p in props])
                table = np.frombuffer(data, kind, count, at)
                at += kind.itemsize * count
                if name == "vertex":
                    vertices = {p[0]: table[p[0]].astype(float) for p in props}
                continue
            rows = []
            for _ in range(count):
                for key, kind in props:
                    if kind[0] == "list":
                        size = np.dtype(order + PLY_TYPES[kind[1]])
                        n = int(np.frombuffer(data, size, 1, at)[0])
                        item = np.dtype(order + PLY_TYPES[kind[2]])
                        if key in ("vertex_index", "vertex_indices"):
                            rows.append(np.frombuffer(data, item, n, at + size.itemsize).tolist())
                        at += size.itemsize + n * item.itemsize
                    else:
                        at += np.dtype(PLY_TYPES[kind[0]]).itemsize
        if name == "face":
            if any(len(r) != 3 for r in rows):
                raise ValueError("only triangles are supported in PLY faces")
            faces = np.array(rows, np.int64).reshape(-1, 3)
    return vertices, faces


def parse_obj(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Points in order of first use by a face (all points if there are no faces),
    and triangles; a quad gives (0, 1, 2) and (3, 0, 2)."""
    points, corners = [], []
    for line in text.splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "v":
            points.append([float(x) for x in w[1:4]])
        elif w[0] == "f":
            ring = [int(x.split("/")[0]) - 1 for x in w[1:]]
            if len(ring) == 3:
                corners.append(ring)
            elif len(ring) == 4:
                corners += [[ring[0], ring[1], ring[2]], [ring[3], ring[0], ring[2]]]
            else:
                raise ValueError("OBJ faces must have three or four corners")
    p = np.array(points, float).reshape(-1, 3)
    if not corners:
        return p, np.empty((0, 3), np.int64)
    f = np.array(corners, np.int64)
    used, first = np.unique(f.ravel(), return_index=True)
    order = used[np.argsort(first)]
    place = np.full(len(p), -1)
    place[order] = np.arange(len(order))
    return p[order], place[f]


def parse_aln(text: str) -> list[tuple[str, list[float]]]:
    """(file, row-major 4x4 matrix) entries; # starts a comment line."""
    words = [w for line in text.splitlines() if not line.lstrip().startswith("#") for w in line.split()]
    out, at = [], 1
    for _ in range(int(words[0])):
        out.append((words[at], [float(x) for x in words[at + 1:at + 17]]))
        at += 17
    return out


def parse_frames(text: str) -> list[float]:
    """The first 16 numbers, column-major, as a row-major matrix."""
    return np.array(text.split()[:16], float).reshape(4, 4).T.ravel().tolist()


def parse_cache(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, normals, colours and faces of a binary sidecar: each a 64-bit count
    and then three values for every column."""
    out, at = [], 0
    for kind in ("<f4", "<f4", "<u2", "<u4"):
        n = int.from_bytes(data[at:at + 8], "little")
        size = np.dtype(kind).itemsize * 3 * n
        out.append(np.frombuffer(data, kind, 3 * n, at + 8).reshape(n, 3))
        at += 8 + size
    return tuple(out)


def cache_bytes(v, n, c, f) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + np.ascontiguousarray(a, k).tobytes()
                    for a, k in zip((v, n, c, f), ("<f4", "<f4", "<u2", "<u4")))
