"""Relations out of jar and war archives: entries, classes, inheritance, references, methods, calls.

Archives are read as binary files, one task each, nested archives included.
Classes are read by the class-file format of the JVM specification; the types of call
targets are those the instructions name.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

ARCHIVE = (".jar", ".war", ".zip", ".jmod")
ENTRY = "archive string, entry string, size long, version int, md5 string, content binary, path string"
FACT = "archive string, relation string, class_name string, name string, target string, call_type string, flags int, line int, seq int, value string, path string"
_NAMES = [x.split()[0] for x in FACT.split(", ")]
#: What a damaged archive or class may raise.
DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError, KeyError, TypeError, IndexError, struct.error)
#: Operand bytes by instruction, for all that have any but the two switches and ``wide``; fixed values of the format.
OPERANDS = {
    1: [16, 18, *range(21, 26), *range(54, 59), 169, 188],
    2: [17, 19, 20, 132, *range(153, 169), *range(178, 185), 187, 189, 192, 193, 198, 199],
    3: [197],
    4: [185, 186, 200, 201],
}
_SIZE = {op: n for n, ops in OPERANDS.items() for op in ops}
#: Call type of each kind of invocation; fixed values.
INVOKE = {182: "VIR", 183: "SPE", 184: "STA", 185: "INT", 186: "DYN"}
#: Kind of each use of a field; fixed values of the format.
FIELD_USE = {178: "GET_STATIC", 179: "PUT_STATIC", 180: "GET", 181: "PUT"}
_PRIMITIVE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
_TYPE = re.compile(r"(\[*)(?:L([^;]+);|([BCDFIJSZV]))")


def type_names(descriptor: str) -> list[str]:
    """Java names of the types in a descriptor, in order."""
    return [(obj.replace("/", ".") if obj else _PRIMITIVE[prim]) + "[]" * len(dims) for dims, obj, prim in _TYPE.findall(descriptor)]


def signature(cls: str, name: str, descriptor: str) -> str:
    args = descriptor[1 : descriptor.index(")")]
    return f"{cls}:{name}({','.join(type_names(args))})"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str):
        out = struct.unpack_from(">" + kind, self.data, self.at)
        self.at += struct.calcsize(">" + kind)
        return out[0] if len(out) == 1 else out

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


class ClassFile:
    """The parts of a class file that the relations need."""

    def __init__(self, data: bytes):
        r = _Reader(data)
        if r.take("I") != 0xCAFEBABE:
            raise ValueError("no class file")
        r.take("HH")
        self.pool: list = [None] * r.take("H")
        i = 1
        while i < len(self.pool):
            tag = r.take("B")
            if tag == 1:
                self.pool[i] = r.bytes(r.take("H")).decode("utf-8", "replace")
            elif tag in (3, 4):
                self.pool[i] = (tag, r.take("I"))
            elif tag in (5, 6):
                self.pool[i] = (tag, r.take("Q"))
                i += 1
            elif tag in (7, 8, 16, 19, 20):
                self.pool[i] = (tag, r.take("H"))
            elif tag == 15:
                self.pool[i] = (tag, *r.take("BH"))
            else:
                self.pool[i] = (tag, *r.take("HH"))
            i += 1
        self.flags = r.take("H")
        self.name, self.parent = self.cls(r.take("H")), self.cls(r.take("H"))
        self.interfaces = [self.cls(r.take("H")) for _ in range(r.take("H"))]
        self.fields, self.methods = self._members(r), self._members(r)
        self.attributes = self._attributes(r)

    def cls(self, i: int) -> str | None:
        return self.pool[self.pool[i][1]].replace("/", ".") if i else None

    def member(self, i: int) -> tuple[str, str, str]:
        _, c, nt = self.pool[i]
        _, name, descriptor = self.pool[nt]
        return self.cls(c), self.pool[name], self.pool[descriptor]

    def _attributes(self, r: _Reader) -> dict[str, bytes]:
        return {self.pool[r.take("H")]: r.bytes(r.take("I")) for _ in range(r.take("H"))}

    def _members(self, r: _Reader) -> list[tuple[int, str, str, dict[str, bytes]]]:
        return [(r.take("H"), self.pool[r.take("H")], self.pool[r.take("H")], self._attributes(r)) for _ in range(r.take("H"))]

    def referenced(self) -> list[str]:
        """Classes the pool names, arrays by their elements, this one aside; itself if there is no other."""
        names = {type_names(n)[0].replace("[]", "") if n.startswith("[") else n.replace("/", ".") for x in self.pool if isinstance(x, tuple) and x[0] == 7 for n in [self.pool[x[1]]]}
        return sorted(names - {self.name} - set(_PRIMITIVE.values())) or [self.name]

    def handles(self, index: int) -> Iterator[tuple[str, str]]:
        """(kind, signature) of the bootstrap method and of the method handles given to it."""
        r = _Reader(self.attributes["BootstrapMethods"])
        for k in range(r.take("H")):
            ref, args = r.take("H"), [r.take("H") for _ in range(r.take("H"))]
            if k == index:
                yield "_BSM", signature(*self.member(self.pool[ref][2]))
                for a in args:
                    if isinstance(self.pool[a], tuple) and self.pool[a][0] == 15 and self.pool[a][1] >= 5:
                        yield "_LM", signature(*self.member(self.pool[a][2]))

    def constant(self, i: int, kind: str) -> object:
        """A constant of an annotation, as Java writes it."""
        v = self.pool[i]
        if isinstance(v, str):
            return v
        form = {3: "i", 4: "f", 5: "q", 6: "d"}[v[0]]
        out = struct.unpack(">" + form, v[1].to_bytes(struct.calcsize(form), "big"))[0]
        return bool(out) if kind == "Z" else chr(out) if kind == "C" else out

    def _element(self, r: _Reader) -> object:
        kind = chr(r.take("B"))
        if kind == "e":
            r.take("H")
            return self.pool[r.take("H")]
        if kind == "c":
            return type_names(self.pool[r.take("H")])[0]
        if kind == "@":
            return self._annotation(r)
        return [self._element(r) for _ in range(r.take("H"))] if kind == "[" else self.constant(r.take("H"), kind)

    def _annotation(self, r: _Reader) -> dict:
        return {"@": type_names(self.pool[r.take("H")])[0], **{self.pool[r.take("H")]: self._element(r) for _ in range(r.take("H"))}}

    def annotations(self, attributes: dict[str, bytes]) -> Iterator[tuple[str, str | None, object]]:
        """(annotation class, attribute, value) of the annotations among the attributes; one without any has a null attribute."""
        for name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            if name in attributes:
                r = _Reader(attributes[name])
                for _ in range(r.take("H")):
                    cls, *pairs = self._annotation(r).items()
                    yield from [(cls[1], k, v) for k, v in pairs] or [(cls[1], None, None)]

    def inner(self) -> Iterator[tuple[str, str | None, int]]:
        """(inner class, outer class, flags) that the class names; classes of methods have no outer one."""
        if "InnerClasses" in self.attributes:
            r = _Reader(self.attributes["InnerClasses"])
            for _ in range(r.take("H")):
                inner, outer, _, flags = r.take("HHHH")
                yield self.cls(inner), self.cls(outer), flags

    def signature_of(self, attributes: dict[str, bytes]) -> str | None:
        return self.pool[struct.unpack(">H", attributes["Signature"])[0]] if "Signature" in attributes else None

    def code(self, data: bytes) -> "Code":
        return Code(self, data)


class Code:
    """Instructions, lines, handlers and variables of one Code attribute."""

    def __init__(self, cls: ClassFile, data: bytes):
        self.cls, r = cls, _Reader(data)
        r.take("HH")
        self.body = r.bytes(r.take("I"))
        self.handlers = [r.take("HHHH") for _ in range(r.take("H"))]
        attributes = cls._attributes(r)
        t = attributes.get("LineNumberTable", b"\0\0")
        self.lines = sorted(struct.unpack_from(">HH", t, 2 + 4 * k) for k in range(struct.unpack_from(">H", t)[0]))
        t = attributes.get("LocalVariableTable", b"\0\0")
        rows = [struct.unpack_from(">HHHHH", t, 2 + 10 * k) for k in range(struct.unpack_from(">H", t)[0])]
        #: Names of the variables that live from the start, by slot.
        self.variables = {slot: cls.pool[name] for start, _, name, _, slot in rows if start == 0}

    def line(self, at: int) -> int | None:
        i = bisect.bisect_right(self.lines, (at, 1 << 16)) - 1
        return self.lines[i][1] if i >= 0 else None

    def instructions(self) -> Iterator[tuple[int, int]]:
        """(place, instruction) in order."""
        body, at = self.body, 0
        while at < len(body):
            op = body[at]
            yield at, op
            if op in (170, 171):
                base = at + 4 - at % 4
                if op == 170:
                    low, high = struct.unpack_from(">ii", body, base + 4)
                    at = base + 12 + 4 * (high - low + 1)
                else:
                    at = base + 8 + 8 * struct.unpack_from(">i", body, base + 4)[0]
            elif op == 196:
                at += 6 if body[at + 1] == 132 else 4
            else:
                at += 1 + _SIZE.get(op, 0)

    def index(self, at: int) -> int:
        return struct.unpack_from(">H", self.body, at + 1)[0]

    def calls(self) -> Iterator[tuple[int, str, str, int | None]]:
        """(place, call type, callee, line), in order."""
        for at, op in self.instructions():
            if op == 186:
                for kind, callee in self.cls.handles(self.cls.pool[self.index(at)][1]):
                    yield at, kind, callee, self.line(at)
            elif op in INVOKE:
                cls, name, descriptor = self.cls.member(self.index(at))
                above = op == 183 and name != "<init>" and cls == self.cls.parent
                yield at, "_CCS_SPE" if above else INVOKE[op], signature(cls, name, descriptor), self.line(at)

    def field_uses(self) -> Iterator[tuple[str, str, str, int | None]]:
        """(kind, class:field, type, line) of uses of fields of other classes."""
        for at, op in self.instructions():
            if op in FIELD_USE:
                cls, name, descriptor = self.cls.member(self.index(at))
                if cls != self.cls.name:
                    yield FIELD_USE[op], f"{cls}:{name}", type_names(descriptor)[0], self.line(at)

    def catches(self, calls: list[tuple]) -> Iterator[tuple[str | None, int | None, int | None, int | None]]:
        """(exception, null for any; line of the handler; first and last number of the calls within) of each guarded range."""
        for start, end, handler, kind in self.handlers:
            inside = [i for i, c in enumerate(calls) if start <= c[0] < end]
            yield self.cls.cls(kind), self.line(handler), inside[0] if inside else None, inside[-1] if inside else None


def plain_attribute(annotation: str, attribute: str, value: object) -> str:
    """The usual form of an annotation's value: texts as they are, the rest as JSON."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def facts(content: bytes, formatter: Callable[[str, str, object], str] = plain_attribute) -> list[tuple]:
    """Rows (relation, class_name, name, target, call_type, flags, line, seq, value) of one class.

    ``formatter`` gives the text of an annotation's value from (annotation class, attribute, value).
    """
    c = ClassFile(content)
    out: list[tuple] = []

    def add(relation: str, name=None, target=None, call_type=None, flags=None, line=None, seq=None, value=None) -> None:
        out.append((relation, c.name, name, target, call_type, flags, line, seq, value))

    def annotated(relation: str, name: str | None, attributes: dict[str, bytes]) -> None:
        for cls, attribute, value in c.annotations(attributes):
            add(relation, name, cls, attribute, value=None if attribute is None else formatter(cls, attribute, value))

    add("class_info", hashlib.md5(content).hexdigest(), c.parent, flags=c.flags, value=c.signature_of(c.attributes))
    if c.parent and c.parent != "java.lang.Object":
        add("extends_impl", None, c.parent, "EXTENDS", c.flags)
    for i in c.interfaces:
        add("extends_impl", None, i, "EXTENDS" if c.flags & 0x200 else "IMPLEMENTS", c.flags)
    for x in c.referenced():
        add("class_reference", None, x)
    for inner, outer, flags in c.inner():
        if c.name in (inner, outer):
            add("inner_class", inner, outer, flags=flags)
    annotated("class_annotation", None, c.attributes)
    for flags, name, d, attributes in c.fields:
        add("field_info", name, type_names(d)[0], flags=flags, value=c.signature_of(attributes))
        annotated("field_annotation", name, attributes)
    for flags, name, d, attributes in c.methods:
        full = signature(c.name, name, d)
        code = c.code(attributes["Code"]) if "Code" in attributes else None
        calls = list(code.calls()) if code else []
        known = [x[3] for x in calls if x[3] is not None]
        add("method_info", full, type_names(d[d.index(")") + 1 :])[0], flags=flags, line=min(known, default=None), value=c.signature_of(attributes))
        slot = 0 if flags & 8 else 1
        for i, t in enumerate(type_names(d[1 : d.index(")")])):
            add("method_argument", full, t, seq=i + 1, value=code.variables.get(slot) if code else None)
            slot += 2 if t in ("long", "double") else 1
        annotated("method_annotation", full, attributes)
        for i, (_, kind, callee, line) in enumerate(calls):
            add("method_call", full, callee, kind, line=line, seq=i)
        for kind, field, t, line in code.field_uses() if code else ():
            add("field_use", full, field, kind, line=line, value=t)
        for kind, line, first, last in code.catches(calls) if code else ():
            add("method_catch", full, kind, line=line, seq=first, flags=last)
    return out


def _walk(name: str, data: bytes) -> Iterator[tuple[str, str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data[4:] if data[:2] == b"JM" else data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                content = z.read(info)
                if info.filename.lower().endswith(ARCHIVE):
                    yield from _walk(f"{name}!{info.filename}", content)
                else:
                    yield name, info.filename, content


#: Bytes of entries that are held at once.
_HELD = 32_000_000


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all archives at ``path``, nested ones too; ``version`` is that of a multi-release entry, ``entry`` without it.

    ``archive`` is the archive's name with those of nested ones, ``path`` the whole path of the file, which tells apart
    archives of one name. Files that are no archive give no row; of a damaged one the entries before the damage
    do, and :func:`archive_errors` names it.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[x.split()[0] for x in ENTRY.split(", ")]).astype({"version": "Int32"})

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows, held = [], 0
                try:
                    for archive, entry, content in _walk(name.rsplit("/", 1)[-1], bytes(data)):
                        m = re.match(r"META-INF/versions/(\d+)/(.*)", entry)
                        rows.append((archive, m[2] if m else entry, len(content), int(m[1]) if m else None, hashlib.md5(content).hexdigest(), content, name))
                        held += len(content)
                        if held > _HELD:
                            yield frame(rows)
                            rows, held = [], 0
                except DAMAGED:
                    pass
                if rows:
                    yield frame(rows)

    return _files(spark, path).mapInPandas(entries, ENTRY)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def archive_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, error) of what can't be read among the archives at ``path``: whole files (null entry) and classes."""

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                if name.lower().endswith(ARCHIVE):
                    try:
                        for _, entry, content in _walk(name, bytes(data)):
                            if entry.endswith(".class"):
                                try:
                                    facts(content)
                                except DAMAGED as e:
                                    rows.append((name, entry, f"{type(e).__name__}: {e}"))
                    except DAMAGED as e:
                        rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "entry", "error"])

    return _files(spark, path).mapInPandas(errors, "path string, entry string, error string")


def read_classes(entries: DataFrame, formatter: Callable[[str, str, object], str] = plain_attribute) -> DataFrame:
    """All relations of the ``.class`` entries as one table (``FACT``); files that are no classes give no row.

    ``formatter`` gives the text of an annotation's value, see :func:`facts`.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for archive, content, path in zip(pdf["archive"], pdf["content"], pdf["path"]):
                try:
                    rows += [(archive, *f, path) for f in facts(bytes(content), formatter)]
                except DAMAGED:
                    continue
            yield pd.DataFrame(rows, columns=_NAMES).astype({c: "Int32" for c in ("flags", "line", "seq")})

    return entries.where(F.col("entry").endswith(".class")).select("archive", "content", "path").mapInPandas(parse, FACT)


def read_others(entries: DataFrame, parsers: Mapping[str, Callable[[bytes], list[tuple[str, str]]]]) -> DataFrame:
    """(path, archive, entry, key, value) of entries that are no classes, by the parser (name ending -> function of the bytes) of the first ending that fits."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, archive, entry, content in zip(pdf["path"], pdf["archive"], pdf["entry"], pdf["content"]):
                f = next((f for end, f in parsers.items() if entry.endswith(end)), None)
                rows += [(path, archive, entry, k, v) for k, v in (f(bytes(content)) if f else ())]
            yield pd.DataFrame(rows, columns=["path", "archive", "entry", "key", "value"])

    return entries.select("path", "archive", "entry", "content").mapInPandas(parse, "path string, archive string, entry string, key string, value string")


def xml_beans(content: bytes) -> list[tuple[str, str]]:
    """(name, class) of the beans a configuration in XML defines: by id, by each name, else by the class; broken XML has none."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError:
        return []
    out = []
    for x in root.iter():
        if x.tag.rsplit("}", 1)[-1] == "bean" and x.get("class"):
            names = [n for n in [x.get("id"), *re.split(r"[,;\s]+", x.get("name") or "")] if n]
            out += [(n, x.get("class")) for n in names or [x.get("class")]]
    return out


def duplicates(entries: DataFrame) -> DataFrame:
    """Archives' files of equal content: (md5, n, entries in order) of entries that occur more than once."""
    at = F.concat_ws("!", "path", "archive", "entry")
    return entries.groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(at)).alias("places")).where("n > 1")


def call_edges(relations: DataFrame) -> DataFrame:
    """Call and inheritance edges (archive, caller, callee, call_type, line_number, enabled) of :func:`read_classes`."""
    edge = relations.where("relation in ('method_call', 'extends_impl')")
    return edge.select("archive", F.coalesce("name", "class_name").alias("caller"), F.col("target").alias("callee"), "call_type", F.col("line").alias("line_number"), F.lit(True).alias("enabled"))
