"""Decoders and encoders of single files: a volume or slice as an array with its geometry."""

from __future__ import annotations

import base64
import gzip
import re
import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass, field

import numpy as np

IDENTITY = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]


@dataclass
class Volume:
    """Named (n, h, w) arrays, spacing and the 4x4 matrix to the world."""

    layers: dict[str, np.ndarray]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    transform: list[float] = field(default_factory=lambda: list(IDENTITY))

    @property
    def first(self) -> np.ndarray:
        return next(iter(self.layers.values()))


def grey(rgb: np.ndarray, weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> np.ndarray:
    return rgb if rgb.ndim == 2 else rgb[..., :3] @ np.array(weights)


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8, 24 or 32 bits: (h, w) or (h, w, 3)."""
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3):
        raise ValueError("compressed bitmaps are not supported")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colors = np.frombuffer(data, np.uint8, 4 * ((start - 14 - size) // 4), 14 + size).reshape(-1, 4)[:, 2::-1]
        return colors[rows][..., 0] if (colors.min(axis=1) == colors.max(axis=1)).all() else colors[rows]
    return rows.reshape(abs(h), w, bits // 8)[..., 2::-1]


def write_bmp(a: np.ndarray) -> bytes:
    """8-bit grey."""
    h, w = a.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = np.clip(np.floor(a[::-1] + 0.5), 0, 255)
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHI", b"BM", 1078 + rows.size, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def read_png(data: bytes) -> np.ndarray:
    """8- or 16-bit grey, colour, palette, with or without alpha; not interlaced."""
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    if interlace or depth not in (8, 16):
        raise ValueError("only 8 and 16 bits without interlacing are supported")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = bands * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    for y in range(h):
        line, up = raw[y, 1:].astype(np.int64), out[y - 1].astype(np.int64) if y else np.zeros(w * step, np.int64)
        kind = raw[y, 0]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            row = line.copy()
            for x in range(w * step):
                a = row[x - step] if x >= step else 0
                b, c = up[x], up[x - step] if x >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else near)) & 255
            out[y] = row
    a = out.reshape(h, w, bands) if depth == 8 else out.view(">u2").astype(np.uint16).reshape(h, w, bands)
    if palette is not None:
        return palette[a[..., 0]]
    return a[..., 0] if bands <= 2 else a


def write_png(a: np.ndarray) -> bytes:
    """8-bit grey, or colour for (h, w, 3)."""
    a = np.clip(np.floor(a + 0.5), 0, 255).astype(np.uint8)
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


# Element types of the formats.
META = {"MET_UCHAR": "u1", "MET_CHAR": "i1", "MET_USHORT": "u2", "MET_SHORT": "i2", "MET_UINT": "u4", "MET_INT": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NRRD = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
VTK = {"UInt8": "u1", "Int8": "i1", "UInt16": "u2", "Int16": "i2", "UInt32": "u4", "Int32": "i4", "Float32": "f4", "Float64": "f8"}


def matrix(columns: list[list[float]], origin: list[float]) -> list[float]:
    return [*(v for i in range(3) for v in (columns[0][i], columns[1][i], columns[2][i], origin[i])), 0.0, 0.0, 0.0, 1.0]


def columns(t: list[float]) -> list[list[float]]:
    return [[t[4 * i + j] for i in range(3)] for j in range(3)]


def read_meta(data: bytes, body: bytes | None = None) -> Volume:
    """MetaImage: a header with its own data, or with that of another file."""
    at, head = 0, {}
    while True:
        end = data.index(b"\n", at)
        key, _, value = data[at:end].decode("latin-1").partition("=")
        head[key.strip()] = value.strip()
        at = end + 1
        if key.strip() == "ElementDataFile":
            break
    size = [int(v) for v in head["DimSize"].split()]
    raw = data[at:] if head["ElementDataFile"] == "LOCAL" else body
    if head.get("CompressedData", "False") == "True":
        raw = zlib.decompress(raw)
    kind = (">" if head.get("BinaryDataByteOrderMSB", head.get("ElementByteOrderMSB", "False")) == "True" else "<") + META[head["ElementType"]]
    t = [float(v) for v in head.get("TransformMatrix", "1 0 0 0 1 0 0 0 1").split()]
    origin = [float(v) for v in head.get("Offset", head.get("Position", "0 0 0")).split()]
    spacing = [float(v) for v in head.get("ElementSpacing", head.get("ElementSize", "1 1 1")).split()]
    return Volume({"src": np.frombuffer(raw, kind, int(np.prod(size))).reshape(size[::-1])}, tuple(spacing), matrix([t[0:3], t[3:6], t[6:9]], origin))


def write_meta(v: Volume) -> bytes:
    a, c = v.first, columns(v.transform)
    kind = {np.dtype(t).str[1:]: name for name, t in META.items()}[a.dtype.str[1:]]
    head = {
        "ObjectType": "Image", "NDims": 3, "BinaryData": "True", "BinaryDataByteOrderMSB": "False", "CompressedData": "False",
        "TransformMatrix": " ".join(repr(float(x)) for col in c for x in col), "Offset": " ".join(repr(float(v.transform[4 * i + 3])) for i in range(3)),
        "ElementSpacing": " ".join(repr(float(s)) for s in v.spacing), "DimSize": " ".join(map(str, a.shape[::-1])), "ElementType": kind, "ElementDataFile": "LOCAL",
    }
    return "".join(f"{k} = {x}\n" for k, x in head.items()).encode() + np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()


def read_nrrd(data: bytes) -> Volume:
    end = data.index(b"\n\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode("latin-1").splitlines() if ": " in line and not line.startswith("#"))
    raw = data[end + 2 :]
    if head.get("encoding", "raw") in ("gzip", "gz"):
        raw = gzip.decompress(raw)
    size = [int(s) for s in head["sizes"].split()]
    kind = (">" if head.get("endian") == "big" else "<") + NRRD[head["type"]]

    def vectors(text: str) -> list[list[float]]:
        return [[float(x) for x in part.split(",")] for part in re.findall(r"\(([^)]*)\)", text)]

    dirs = vectors(head.get("space directions", "(1,0,0) (0,1,0) (0,0,1)"))
    spacing = [float(np.linalg.norm(d)) for d in dirs]
    origin = vectors(head.get("space origin", "(0,0,0)"))[0]
    return Volume({"src": np.frombuffer(raw, kind, int(np.prod(size))).reshape(size[::-1])}, tuple(spacing), matrix([[x / s for x in d] for d, s in zip(dirs, spacing, strict=True)], origin))


def write_nrrd(v: Volume) -> bytes:
    a = v.first
    kind = {"u1": "uint8", "i1": "int8", "u2": "uint16", "i2": "int16", "u4": "uint32", "i4": "int32", "f4": "float", "f8": "double"}[a.dtype.str[1:]]

    def vector(x: list[float]) -> str:
        return "(" + ",".join(repr(float(y)) for y in x) + ")"

    dirs = " ".join(vector([x * s for x in c]) for c, s in zip(columns(v.transform), v.spacing, strict=True))
    head = f"NRRD0004\ntype: {kind}\ndimension: 3\nspace: left-posterior-superior\nsizes: {' '.join(map(str, a.shape[::-1]))}\nspace directions: {dirs}\nendian: little\nencoding: gzip\nspace origin: {vector([v.transform[4 * i + 3] for i in range(3)])}\n\n"
    return head.encode() + gzip.compress(np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes())


def read_nifti(data: bytes) -> Volume:
    """NIfTI-1 in one file, zipped or not. Its axes point right and forward; ours left and back."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    e = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    dim = struct.unpack_from(e + "8h", data, 40)
    kind, (start,) = struct.unpack_from(e + "h", data, 70)[0], struct.unpack_from(e + "f", data, 108)
    spacing = struct.unpack_from(e + "8f", data, 76)[1:4]
    slope, inter = struct.unpack_from(e + "2f", data, 112)
    rows = [struct.unpack_from(e + "4f", data, 280 + 16 * i) for i in range(3)]
    size = [max(1, d) for d in dim[1:4]]
    a = np.frombuffer(data, e + NIFTI[kind], int(np.prod(size)), int(start)).reshape(size[::-1])
    if slope and (slope != 1 or inter):
        a = a * slope + inter
    if struct.unpack_from(e + "h", data, 254)[0] <= 0:
        rows = [(spacing[0], 0, 0, 0), (0, spacing[1], 0, 0), (0, 0, spacing[2], 0)]
    sign = (-1, -1, 1)
    cols = [[rows[i][j] * sign[i] / spacing[j] for i in range(3)] for j in range(3)]
    return Volume({"src": a}, tuple(float(s) for s in spacing), matrix(cols, [rows[i][3] * sign[i] for i in range(3)]))


def write_nifti(v: Volume) -> bytes:
    a = v.first
    kind = {t: k for k, t in NIFTI.items()}[a.dtype.str[1:]]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *a.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<hh", head, 70, kind, a.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *v.spacing, 0, 0, 0, 0)
    struct.pack_into("<fff", head, 108, 352, 1, 0)
    struct.pack_into("<hh", head, 252, 0, 1)
    c, sign = columns(v.transform), (-1, -1, 1)
    for i in range(3):
        struct.pack_into("<4f", head, 280 + 16 * i, *[c[j][i] * sign[i] * v.spacing[j] for j in range(3)], v.transform[4 * i + 3] * sign[i])
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes())


def read_vti(data: bytes) -> Volume:
    """Image data in text or base64, with named arrays."""
    root = ET.fromstring(data)
    img = root.find("ImageData")
    x0, x1, y0, y1, z0, z1 = map(int, img.get("WholeExtent").split())
    shape = (z1 - z0 + 1, y1 - y0 + 1, x1 - x0 + 1)
    wide = "u8" if root.get("header_type") == "UInt64" else "u4"
    layers = {}
    for node in img.iter("DataArray"):
        kind = "<" + VTK[node.get("type")]
        text = (node.text or "").strip()
        if node.get("format") == "ascii":
            a = np.array(text.split(), dtype=kind)
        else:
            a = np.frombuffer(base64.b64decode(text)[np.dtype(wide).itemsize :], kind)
        layers[node.get("Name") or f"array{len(layers)}"] = a.reshape(shape)
    spacing = tuple(float(s) for s in img.get("Spacing", "1 1 1").split())
    origin = [float(s) for s in img.get("Origin", "0 0 0").split()]
    return Volume(layers, spacing, matrix([[1, 0, 0], [0, 1, 0], [0, 0, 1]], origin))


def write_vti(v: Volume) -> bytes:
    n, h, w = v.first.shape
    names = {t: k for k, t in VTK.items()}
    arrays = ""
    for name, a in v.layers.items():
        raw = np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<")).tobytes()
        arrays += f'<DataArray Name="{name}" type="{names[a.dtype.str[1:]]}" format="binary">{base64.b64encode(struct.pack("<I", len(raw)) + raw).decode()}</DataArray>'
    extent = f"0 {w - 1} 0 {h - 1} 0 {n - 1}"
    origin = " ".join(repr(float(v.transform[4 * i + 3])) for i in range(3))
    return f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="0.1" byte_order="LittleEndian"><ImageData WholeExtent="{extent}" Origin="{origin}" Spacing="{" ".join(repr(float(s)) for s in v.spacing)}"><Piece Extent="{extent}"><PointData>{arrays}</PointData></Piece></ImageData></VTKFile>'.encode()


#: Types of the legacy VTK and AmiraMesh formats.
VTK_TYPES = {"u1": "unsigned_char", "i1": "char", "u2": "unsigned_short", "i2": "short", "u4": "unsigned_int", "i4": "int", "f4": "float", "f8": "double"}
AMIRA_TYPES = {"u1": "byte", "i2": "short", "u2": "ushort", "i4": "int", "f4": "float", "f8": "double"}


def as_text(a: np.ndarray) -> str:
    """Values a row of x a line, with the digits that give them back."""
    return "\n".join(" ".join(map(str, row)) for row in a.reshape(-1, a.shape[-1]).astype(a.dtype.newbyteorder("="))) + "\n"


def placed(spacing: list[float], origin: list[float]) -> dict:
    transform = list(IDENTITY)
    for i in range(3):
        transform[4 * i + 3] = origin[i]
    return {"spacing": tuple(spacing), "transform": transform}


def write_vtk(v: Volume, text: bool = True) -> bytes:
    """Legacy VTK structured points, as text or big-endian; the format has no rotation."""
    a = v.first
    name, kind = next(iter(v.layers)), VTK_TYPES[a.dtype.str[1:]]
    origin = " ".join(repr(float(v.transform[4 * i + 3])) for i in range(3))
    head = f"# vtk DataFile Version 3.0\nvolume\n{'ASCII' if text else 'BINARY'}\nDATASET STRUCTURED_POINTS\nDIMENSIONS {' '.join(map(str, a.shape[::-1]))}\nSPACING {' '.join(repr(float(x)) for x in v.spacing)}\nORIGIN {origin}\nPOINT_DATA {a.size}\nSCALARS {name} {kind} 1\nLOOKUP_TABLE default\n"
    body = as_text(a).encode() if text else np.ascontiguousarray(a).astype(a.dtype.newbyteorder(">")).tobytes() + b"\n"
    return head.encode() + body


def read_vtk(data: bytes) -> Volume:
    """The first scalars of legacy VTK structured points."""
    start = re.search(rb"LOOKUP_TABLE\s+\S+[ \t]*\r?\n", data).end()
    head = data[:start].decode("latin-1")

    def field(key: str) -> list[str]:
        return re.search(rf"^{key}\s+(.+?)\s*$", head, re.M)[1].split()

    shape = tuple(map(int, field("DIMENSIONS")[::-1]))
    name, kind = field("SCALARS")[:2]
    dtype = next(np.dtype(k) for k, t in VTK_TYPES.items() if t == kind)
    size = int(np.prod(shape))
    text = head.split("\n")[2].strip() == "ASCII"
    a = np.array(data[start:].split()[:size], dtype="f8").astype(dtype) if text else np.frombuffer(data, dtype.newbyteorder(">"), size, start)
    return Volume({name: a.reshape(shape)}, **placed([float(x) for x in field("SPACING")], [float(x) for x in field("ORIGIN")]))


def write_amira(v: Volume) -> bytes:
    """AmiraMesh text with uniform coordinates; the box spans the centres of voxels."""
    a = v.first
    kind, sizes = AMIRA_TYPES[a.dtype.str[1:]], a.shape[::-1]
    origin = [float(v.transform[4 * i + 3]) for i in range(3)]
    box = " ".join(f"{o!r} {o + (m - 1) * float(s)!r}" for o, m, s in zip(origin, sizes, v.spacing, strict=True))
    head = f'# AmiraMesh 3D ASCII 2.0\n\ndefine Lattice {" ".join(map(str, sizes))}\n\nParameters {{\n    Content "{"x".join(map(str, sizes))} {kind}, uniform coordinates",\n    BoundingBox {box},\n    CoordType "uniform"\n}}\n\nLattice {{ {kind} Data }} @1\n\n# Data section follows\n@1\n'
    return head.encode() + as_text(a).encode()


def read_amira(data: bytes) -> Volume:
    """One lattice of AmiraMesh text; an axis of one voxel has spacing 1."""
    start = re.search(rb"^@1[ \t]*\r?\n", data, re.M).end()
    head = data[:start].decode("latin-1")
    sizes = [int(x) for x in re.search(r"define Lattice (\d+) (\d+) (\d+)", head).groups()]
    kind = re.search(r"Lattice \{ (\w+) ", head)[1]
    dtype = next(np.dtype(k) for k, t in AMIRA_TYPES.items() if t == kind)
    box = [float(x) for x in re.search(r"BoundingBox ([^,\n]+)", head)[1].split()]
    spacing = [(box[2 * i + 1] - box[2 * i]) / (m - 1) if m > 1 else 1.0 for i, m in enumerate(sizes)]
    a = np.array(data[start:].split()[: int(np.prod(sizes))], dtype="f8").astype(dtype)
    return Volume({"src": a.reshape(sizes[::-1])}, **placed(spacing, box[::2]))


def dicom_tags(data: bytes) -> dict[tuple[int, int], bytes]:
    """Values by tag of a little-endian file, explicit or implicit; sequences of undefined length are skipped."""
    at, explicit, out = (132 if data[128:132] == b"DICM" else 0), True, {}
    syntax = None
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<HH", data, at)
        if group != 2 and syntax is not None:
            explicit = syntax != b"1.2.840.10008.1.2"
        kind = data[at + 4 : at + 6]
        if (explicit or group == 2) and kind.isalpha():
            if kind in (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN"):
                size, start = struct.unpack_from("<I", data, at + 8)[0], at + 12
            else:
                size, start = struct.unpack_from("<H", data, at + 6)[0], at + 8
        else:
            size, start = struct.unpack_from("<I", data, at + 4)[0], at + 8
        if size == 0xFFFFFFFF:
            end = data.find(b"\xfe\xff\xdd\xe0", start)
            at = end + 8 if end >= 0 else len(data)
            continue
        value = data[start : start + size]
        if (group, element) == (2, 0x10):
            syntax = value.rstrip(b"\0 ")
        out[group, element] = value
        at = start + size
    return out


def read_dicom(data: bytes) -> tuple[np.ndarray, dict[str, float]]:
    """Rescaled pixels (h, w), or (n, h, w) of a dose grid, and position, spacing, thickness, series."""
    tags = dicom_tags(data)

    def text(g: int, e: int, other: str = "") -> str:
        return tags.get((g, e), other.encode()).decode("latin-1").strip("\0 ")

    def short(g: int, e: int, other: int) -> int:
        return struct.unpack("<H", tags[g, e][:2])[0] if (g, e) in tags else other

    h, w, bits, sign = short(0x28, 0x10, 0), short(0x28, 0x11, 0), short(0x28, 0x100, 16), short(0x28, 0x103, 0)
    n = int(text(0x28, 0x8, "1") or 1)
    a = np.frombuffer(tags[0x7FE0, 0x10], f"<{'i' if sign else 'u'}{bits // 8}", n * h * w).reshape(n, h, w)
    scale = float(text(0x3004, 0xE, "") or text(0x28, 0x1053, "1") or 1)
    a = a * scale + float(text(0x28, 0x1052, "0") or 0)
    place = [float(v) for v in (text(0x20, 0x32) or "0\\0\\0").split("\\")]
    step = [float(v) for v in (text(0x28, 0x30) or "1\\1").split("\\")]
    meta = {"px": place[0], "py": place[1], "pz": place[2], "dy": step[0], "dx": step[1], "thickness": float(text(0x18, 0x50, "1") or 1), "series": float(text(0x20, 0x11, "0") or 0)}
    return (a[0] if n == 1 else a), meta


def read_avw(data: bytes) -> Volume:
    """Header of name=value lines, then binary slices at the volume's offset."""
    head = dict(re.findall(r"^\s*(\w+)=(\S+)", data[:8192].split(b"EndInformation")[0].decode("latin-1"), re.M))
    kind = {"AVW_UNSIGNED_CHAR": "u1", "AVW_SIGNED_CHAR": "i1", "AVW_UNSIGNED_SHORT": "u2", "AVW_SIGNED_SHORT": "i2", "AVW_UNSIGNED_INT": "u4", "AVW_SIGNED_INT": "i4", "AVW_FLOAT": "f4"}[head["DataType"]]
    order = "<" if head.get("Endian", "Little") == "Little" else ">"
    shape = tuple(int(head[k]) for k in ("Depth", "Height", "Width"))
    start = int(re.match(rb"AVW_ImageFile\s+\S+\s+(\d+)", data)[1])
    return Volume({"src": np.frombuffer(data, order + kind, int(np.prod(shape)), start).reshape(shape)}, tuple(float(head.get(f"Voxel{k}", 1)) for k in ("Width", "Height", "Depth")))


READERS = {"mhd": read_meta, "mha": read_meta, "nrrd": read_nrrd, "nii": read_nifti, "gz": read_nifti, "vti": read_vti, "avw": read_avw, "vtk": read_vtk, "am": read_amira}
WRITERS = {"mha": write_meta, "nrrd": write_nrrd, "gz": write_nifti, "vti": write_vti, "vtk": write_vtk, "vtkb": lambda v: write_vtk(v, text=False), "am": write_amira}


def read_volume(name: str, data: bytes) -> Volume:
    return READERS[name.rsplit(".", 1)[-1].lower()](data)
