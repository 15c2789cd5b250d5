"""Message definitions: the text of ``ros2msg`` schemas to layouts, Spark types and Arrow types."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

#: Primitive names of the message language: struct code, Arrow type, Spark type (no unsigned ones: the next wider).
PRIMITIVES: dict[str, tuple[str, pa.DataType, T.DataType]] = {
    "bool": ("?", pa.bool_(), T.BooleanType()),
    "byte": ("B", pa.int16(), T.ShortType()),
    "char": ("B", pa.int16(), T.ShortType()),
    "int8": ("b", pa.int8(), T.ByteType()),
    "uint8": ("B", pa.int16(), T.ShortType()),
    "int16": ("h", pa.int16(), T.ShortType()),
    "uint16": ("H", pa.int32(), T.IntegerType()),
    "int32": ("i", pa.int32(), T.IntegerType()),
    "uint32": ("I", pa.int64(), T.LongType()),
    "int64": ("q", pa.int64(), T.LongType()),
    "uint64": ("Q", pa.decimal128(20, 0), T.DecimalType(20, 0)),
    "float32": ("f", pa.float32(), T.FloatType()),
    "float64": ("d", pa.float64(), T.DoubleType()),
}
STRING = "string"

_FIELD = re.compile(r"^(?P<base>[A-Za-z][\w/]*)(?:<=(?P<bound>\d+))?(?P<array>\[(?:<?=?)?(?P<size>\d*)\])?$")


@dataclass(frozen=True)
class Field:
    """``base`` is a primitive, ``string`` or a full message name; ``length``: None for no array, -1 for a
    sequence, else the fixed size."""

    name: str
    base: str
    length: int | None = None


Layouts = dict[str, list[Field]]
BUILTIN: Layouts = {
    "builtin_interfaces/Time": [Field("sec", "int32"), Field("nanosec", "uint32")],
    "builtin_interfaces/Duration": [Field("sec", "int32"), Field("nanosec", "uint32")],
}


def short(name: str) -> str:
    """``pkg/msg/Name`` and ``pkg/Name`` are one type, written ``pkg/Name``."""
    parts = name.split("/")
    return f"{parts[0]}/{parts[-1]}" if len(parts) > 1 else name


def _without_comment(line: str) -> str:
    """The line up to a ``#`` that stands outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#":
            return line[:i]
    return line


def parse_fields(text: str, package: str) -> list[tuple[Field, str]]:
    """Fields of one definition with the package to resolve them in; constants are no fields, defaults are ignored."""
    out = []
    for line in text.splitlines():
        tokens = _without_comment(line).split()
        if len(tokens) < 2 or "=" in tokens[1] or (len(tokens) > 2 and tokens[2].startswith("=")):
            continue
        m = _FIELD.match(tokens[0])
        if not m:
            raise ValueError(f"can't read the field {line.strip()!r}")
        if m["base"] == "wstring":
            raise ValueError("wstring fields aren't supported")
        length = None if m["array"] is None else (int(m["size"]) if m["size"] and "<" not in m["array"] else -1)
        out.append((Field(tokens[1], m["base"], length), package))
    return out


def parse_schema(text: str, root: str) -> Layouts:
    """All layouts of an embedded schema: the root's definition, then blocks behind lines of ``=`` with ``MSG: name``."""
    blocks = re.split(r"(?m)^=+\s*$", text)
    raw: dict[str, list[tuple[Field, str]]] = {}
    name = short(root)
    raw[name] = parse_fields(blocks[0], name.split("/")[0])
    for block in blocks[1:]:
        head, _, body = block.lstrip().partition("\n")
        if head.startswith("MSG:"):
            name = short(head[4:].strip())
            raw[name] = parse_fields(body, name.split("/")[0])
    return resolve(raw)


def resolve(raw: dict[str, list[tuple[Field, str]]], known: Layouts | None = None) -> Layouts:
    """Replace short type names: as they are, in the enclosing package, then by the last part alone."""
    known = BUILTIN | (known or {})
    names = set(raw) | set(known)

    def full(f: Field, package: str) -> Field:
        if f.base in PRIMITIVES or f.base == STRING:
            return f
        tries = [short(f.base), f"{package}/{f.base}", "std_msgs/Header" if f.base == "Header" else "", f"builtin_interfaces/{f.base}"]
        tries += sorted(n for n in names if n.rpartition("/")[2] == f.base.rpartition("/")[2])
        found = next((n for n in tries if n in names), None)
        if found is None:
            raise ValueError(f"unknown message type {f.base!r} in {package}")
        return Field(f.name, found, f.length)

    return known | {name: [full(f, p) for f, p in fields] for name, fields in raw.items()}


def register_msg_types(paths: Iterable[str], layouts: Layouts) -> int:
    """Add the definitions ``<package>/msg/<Name>.msg`` below ``paths`` to ``layouts``; the number of new types.

    Known types stay; files that can't be parsed, or need unknown types, are left out.
    """
    raw: dict[str, list[tuple[Field, str]]] = {}
    for top in paths:
        for folder, _, files in os.walk(os.path.expanduser(os.path.expandvars(top))):
            if os.path.basename(folder) != "msg":
                continue
            package = os.path.basename(os.path.dirname(folder))
            for file in sorted(files):
                name = f"{package}/{file[:-4]}"
                if file.endswith(".msg") and name not in layouts and name not in raw:
                    try:
                        with open(os.path.join(folder, file), encoding="utf-8") as f:
                            raw[name] = parse_fields(f.read(), package)
                    except (ValueError, OSError):
                        continue
    while raw:
        try:
            found = resolve(raw, layouts)
        except ValueError:
            bad = [n for n in raw if not _resolves(n, raw, layouts)]
            for n in bad:
                del raw[n]
            continue
        layouts.update({n: found[n] for n in raw})
        return len(raw)
    return 0


def _resolves(name: str, raw: dict[str, list[tuple[Field, str]]], layouts: Layouts) -> bool:
    try:
        resolve({name: raw[name]}, layouts | {n: [] for n in raw})
    except ValueError:
        return False
    return True


def spark_type(layouts: Layouts, name: str) -> T.StructType:
    """The struct of a message, in definition order."""

    def of(f: Field) -> T.DataType:
        base = PRIMITIVES[f.base][2] if f.base in PRIMITIVES else T.StringType() if f.base == STRING else spark_type(layouts, f.base)
        return base if f.length is None else T.ArrayType(base)

    return T.StructType([T.StructField(f.name, of(f)) for f in layouts[name]])


def arrow_type(layouts: Layouts, name: str) -> pa.StructType:
    def of(f: Field) -> pa.DataType:
        base = PRIMITIVES[f.base][1] if f.base in PRIMITIVES else pa.string() if f.base == STRING else arrow_type(layouts, f.base)
        return base if f.length is None else pa.list_(base)

    return pa.struct([pa.field(f.name, of(f)) for f in layouts[name]])


#: Definitions that recordings without embedded ones need most; the message language's own texts, fixed values.
COMMON = {
    "std_msgs/Header": "builtin_interfaces/Time stamp\nstring frame_id",
    "std_msgs/String": "string data",
    "std_msgs/Bool": "bool data",
    "std_msgs/Float64": "float64 data",
    "std_msgs/Int32": "int32 data",
    "geometry_msgs/Vector3": "float64 x\nfloat64 y\nfloat64 z",
    "geometry_msgs/Point": "float64 x\nfloat64 y\nfloat64 z",
    "geometry_msgs/Quaternion": "float64 x\nfloat64 y\nfloat64 z\nfloat64 w",
    "geometry_msgs/Pose": "Point position\nQuaternion orientation",
    "geometry_msgs/PoseStamped": "std_msgs/Header header\nPose pose",
    "geometry_msgs/PoseWithCovariance": "Pose pose\nfloat64[36] covariance",
    "geometry_msgs/Twist": "Vector3 linear\nVector3 angular",
    "geometry_msgs/TwistStamped": "std_msgs/Header header\nTwist twist",
    "geometry_msgs/TwistWithCovariance": "Twist twist\nfloat64[36] covariance",
    "geometry_msgs/Vector3Stamped": "std_msgs/Header header\nVector3 vector",
    "nav_msgs/Odometry": "std_msgs/Header header\nstring child_frame_id\ngeometry_msgs/PoseWithCovariance pose\ngeometry_msgs/TwistWithCovariance twist",
    "nav_msgs/Path": "std_msgs/Header header\ngeometry_msgs/PoseStamped[] poses",
    "sensor_msgs/JointState": "std_msgs/Header header\nstring[] name\nfloat64[] position\nfloat64[] velocity\nfloat64[] effort",
    "sensor_msgs/Imu": "std_msgs/Header header\ngeometry_msgs/Quaternion orientation\nfloat64[9] orientation_covariance\ngeometry_msgs/Vector3 angular_velocity\nfloat64[9] angular_velocity_covariance\ngeometry_msgs/Vector3 linear_acceleration\nfloat64[9] linear_acceleration_covariance",
}


def common_layouts() -> Layouts:
    return resolve({n: parse_fields(text, n.split("/")[0]) for n, text in COMMON.items()})
