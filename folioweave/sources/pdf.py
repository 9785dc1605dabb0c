"""Text runs from the bytes of PDF files (SRC-01, SRC-02).

Files come through Spark's own binary source, so any store that Spark reads will
do. A first pass goes through a file's cross-references and gives one row a page
(its content stream and the fonts it names); pages are then dealt anew, so a long
document is many tasks, and a second pass runs each page's text operators.

Read are cross-reference tables and streams, object streams, Flate with PNG
predictors and hexadecimal streams, simple fonts with their widths and Type 0
fonts with a map to Unicode. What is not read (encryption, other filters, codes
that no encoding or map names, fonts without widths, drawn forms) is reported for
its file and page in `problem`, not guessed; the rest of the file goes on.
"""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import files, merged_blanks

PAGE = "doc string, page int, width double, height double, content binary, fonts string, problem string"
RUN = "doc string, page int, id long, text string, x0 double, y0 double, x1 double, y1 double, font string, size double, bold boolean, italic boolean, block int, line int, problem string"
#: Bytes that one content stream may unpack to.
MOST = 64 << 20
#: Rows, and bytes of streams, of one batch that goes back to Spark.
ROWS, LARGE = 1000, 8 << 20

# Glyph names beyond letters and `uni` names.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ff": "ff", "fi": "fi", "fl": "fl", "ffi": "ffi", "ffl": "ffl",
}


class Ref(NamedTuple):
    number: int


class Name(str):
    pass


class Word(str):
    """An operator or keyword."""


class Stream(NamedTuple):
    about: dict
    raw: bytes


class Bad(ValueError):
    """What this reader does not read."""


SPACES, ENDS = b" \t\r\n\f\0", b" \t\r\n\f\0()<>[]{}/%"
STRING = re.compile(rb"[()\\]")
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Items:
    """The objects that stand one behind the other in some bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d = self.data
        while self.at < len(d) and (d[self.at] in SPACES or d[self.at] == 37):
            if d[self.at] == 37:
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                self.at += 1

    def _token(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in ENDS:
            self.at += 1
        return self.data[start : self.at]

    def _string(self) -> bytes:
        out, depth, d = bytearray(), 1, self.data
        while True:
            m = STRING.search(d, self.at)
            if not m:
                raise Bad("a string has no end")
            out += d[self.at : m.start()]
            c, self.at = d[m.start()], m.end()
            if c == 92:
                e = d[self.at] if self.at < len(d) else 92
                octal = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                elif e in b"\r\n":
                    self.at += 2 if d[self.at : self.at + 2] == b"\r\n" else 1
                else:
                    out.append(ESCAPES.get(e, e))
                    self.at += 1
            else:
                depth += 1 if c == 40 else -1
                if not depth:
                    return bytes(out)
                out.append(c)

    def next(self):
        """The next object; Word("") at the end."""
        self._skip()
        d = self.data
        if self.at >= len(d):
            return Word("")
        c = d[self.at]
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            flat = self._until(">>")
            return {k: v for k, v in zip(flat[::2], flat[1::2], strict=False) if isinstance(k, Name)}
        self.at += 1
        if c == 40:
            return self._string()
        if c == 91:
            return self._until("]")
        if c == 60:
            end = d.find(b">", self.at)
            digits = re.sub(rb"\s", b"", d[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 47:
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._token()).decode("latin-1"))
        if c in b"]>{})":
            if d[self.at - 1 : self.at + 1] == b">>":
                self.at += 1
                return Word(">>")
            return Word(chr(c))
        self.at -= 1
        token = self._token()
        if re.fullmatch(rb"[+-]?\d+", token):
            ahead = re.compile(rb"\s+(\d+)\s+R(?![^\s()<>\[\]{}/%])").match(d, self.at)
            if ahead and token.isdigit():
                self.at = ahead.end()
                return Ref(int(token))
            return int(token)
        if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", token):
            return float(token)
        return {b"true": True, b"false": False, b"null": None}.get(token, Word(token.decode("latin-1")))

    def _until(self, end: str) -> list:
        out = []
        while (x := self.next()) != Word(end) or not isinstance(x, Word):
            if isinstance(x, Word) and x == "":
                raise Bad("an array or dictionary has no end")
            out.append(x)
        return out


def unpacked(stream: Stream, get) -> bytes:
    """A stream's bytes behind its filters."""
    data, kinds, parms = stream.raw, get(stream.about.get("Filter")) or [], get(stream.about.get("DecodeParms")) or {}
    kinds, parms = (kinds, parms) if isinstance(kinds, list) else ([kinds], [parms])
    for kind, parm in zip(kinds, [*(parms if isinstance(parms, list) else [parms]), *[{}] * len(kinds)], strict=False):
        if kind == "ASCIIHexDecode":
            data = Items(b"<" + data.split(b">")[0] + b">").next()
        elif kind != "FlateDecode":
            raise Bad(f"filter {kind}")
        else:
            data = zlib.decompressobj().decompress(data, MOST)
            parm = get(parm) or {}
            if parm.get("Predictor", 1) >= 10:
                width = parm.get("Columns", 1) * parm.get("Colors", 1) * parm.get("BitsPerComponent", 8) // 8
                rows, before = [], bytes(width)
                for i in range(0, len(data) - width, width + 1):
                    kind_, row = data[i], data[i + 1 : i + 1 + width]
                    if kind_ not in (0, 2):
                        raise Bad(f"predictor {kind_}")
                    before = bytes((a + b) & 255 for a, b in zip(row, before, strict=True)) if kind_ == 2 else row
                    rows.append(before)
                data = b"".join(rows)
            elif parm.get("Predictor", 1) != 1:
                raise Bad(f"predictor {parm['Predictor']}")
    return data


class File:
    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.known = data, {}, {}, {}
        found = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*$", data[-1024:])
        at, seen = int(found[1]) if found else None, set()
        while at is not None and at not in seen:
            seen.add(at)
            at = self._references(at)
        if not self.places:
            raise Bad("no cross-references")
        if "Encrypt" in self.trailer:
            raise Bad("encryption")

    def _references(self, at: int) -> int | None:
        items = Items(self.data, at)
        if items.next() == Word("xref"):
            while (first := items.next()) != Word("trailer"):
                if not isinstance(first, int):
                    raise Bad("cross-reference table")
                for n in range(first, first + items.next()):
                    place, _, kind = items.next(), items.next(), items.next()
                    if kind == "n":
                        self.places.setdefault(n, (1, place))
            about = items.next()
            if "XRefStm" in about:
                self._references(about["XRefStm"])
        else:
            stream = self._at(at)
            if not isinstance(stream, Stream):
                raise Bad("cross-references")
            about, rows = stream.about, unpacked(stream, lambda x: x)
            w = about["W"]
            index = about.get("Index") or [0, about["Size"]]
            numbers = [n for a, k in zip(index[::2], index[1::2], strict=True) for n in range(a, a + k)]
            for i, n in enumerate(numbers):
                row = rows[i * sum(w) : (i + 1) * sum(w)]
                kind, a, b = (int.from_bytes(row[sum(w[:k]) : sum(w[: k + 1])], "big") for k in range(3))
                kind = kind if w[0] else 1
                if kind in (1, 2):
                    self.places.setdefault(n, (1, a) if kind == 1 else (2, a, b))
        self.trailer = {**about, **self.trailer}
        return about.get("Prev")

    def _at(self, at: int):
        items = Items(self.data, at)
        if not isinstance(items.next(), int) or not isinstance(items.next(), int) or items.next() != Word("obj"):
            raise Bad("a cross-reference leads to no object")
        value = items.next()
        m = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(self.data, items.at)
        if isinstance(value, dict) and m:
            size = self.get(value.get("Length"))
            end = m.end() + size if isinstance(size, int) else self.data.find(b"endstream", m.end())
            return Stream(value, self.data[m.end() : end])
        return value

    def get(self, x):
        """What a reference leads to; other objects as they are."""
        if not isinstance(x, Ref):
            return x
        if x.number not in self.known:
            self.known[x.number] = None
            place = self.places.get(x.number)
            if place and place[0] == 1:
                self.known[x.number] = self._at(place[1])
            elif place:
                holder = self.get(Ref(place[1]))
                data = unpacked(holder, self.get)
                head = Items(data)
                table = [(head.next(), head.next()) for _ in range(holder.about["N"])]
                self.known[x.number] = Items(data, holder.about["First"] + dict(table)[x.number]).next()
        return self.known[x.number]

    def pages(self):
        """Page dictionaries with what they inherit."""
        stack, seen = [(self.get(self.trailer.get("Root"))["Pages"], {})], set()
        while stack:
            ref, above = stack.pop()
            if ref in seen:
                continue
            seen.add(ref)
            node = {**above, **(self.get(ref) or {})}
            if "Kids" in node:
                passed = {k: node[k] for k in ("Resources", "MediaBox", "Rotate") if k in node}
                stack += [(kid, passed) for kid in reversed(self.get(node["Kids"]))]
            else:
                yield node


def named(glyph: str) -> str | None:
    if len(glyph) == 1:
        return glyph
    return chr(int(glyph[3:7], 16)) if re.fullmatch(r"uni[0-9A-F]{4}", glyph) else GLYPHS.get(glyph)


def to_unicode(data: bytes) -> tuple[dict[int, str], int]:
    """Codes and their texts of a map to Unicode, and the bytes of a code."""
    out, width, items, held = {}, 1, Items(data), []
    text = lambda b: b.decode("utf-16-be", "replace")
    number = lambda b: int.from_bytes(b, "big")
    while (x := items.next()) != Word("") or not isinstance(x, Word):
        if not isinstance(x, Word):
            held.append(x)
            continue
        if x == "endcodespacerange" and held:
            width = len(held[-1])
        elif x == "endbfchar":
            out |= {number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
        elif x == "endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                for i in range(number(b) - number(a) + 1):
                    out[number(a) + i] = text(c[i]) if isinstance(c, list) else text((number(c) + i).to_bytes(len(c), "big"))
        held = []
    return out, width


def font(file: File, about: dict) -> dict:
    """What a page needs of a font: name, texts and widths by code, bytes of a code, ascent, descent, flags, problems."""
    get, problems = file.get, []
    kind, inner, texts, width = about.get("Subtype"), about, {}, 1
    if isinstance(get(about.get("ToUnicode")), Stream):
        texts, width = to_unicode(unpacked(get(about["ToUnicode"]), get))
    widths, default = {}, 0
    if kind == "Type0":
        inner, width = get(get(about["DescendantFonts"])[0]), 2
        if not texts:
            problems.append("a font without a map to Unicode")
        default, row = inner.get("DW", 1000), get(inner.get("W")) or []
        while row:
            if isinstance(get(row[1]), list):
                widths |= {row[0] + i: w for i, w in enumerate(get(row[1]))}
                row = row[2:]
            else:
                widths |= dict.fromkeys(range(row[0], row[1] + 1), row[2])
                row = row[3:]
    else:
        encoding, width = get(about.get("Encoding")), 1
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(base)
        known = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)} if codec else {c: chr(c) for c in range(32, 127)} | {39: "’", 96: "‘"}
        if isinstance(encoding, dict):
            code = 0
            for x in get(encoding.get("Differences")) or []:
                if isinstance(x, Name):
                    known[code] = named(x)
                    code += 1
                else:
                    code = x
        texts = {**{c: t for c, t in known.items() if t}, **texts}
        first = about.get("FirstChar", 0)
        widths = {first + i: get(w) for i, w in enumerate(get(about.get("Widths")) or [])}
        if not widths:
            if "Courier" in about.get("BaseFont", ""):
                default = 600
            else:
                problems.append(f"no widths of {about.get('BaseFont')}")
    more = get(inner.get("FontDescriptor")) or {}
    return {"name": about.get("BaseFont", ""), "texts": texts, "widths": widths, "default": more.get("MissingWidth", default), "bytes": width, "up": more.get("Ascent", 800) or 800, "down": more.get("Descent", -200) or -200, "flags": more.get("Flags", 0), "problems": problems}


def file_pages(doc: str, data: bytes):
    """A row of PAGE for each page; one with a problem alone where the file can't be read."""
    try:
        file = File(data)
        for n, page in enumerate(file.pages(), 1):
            try:
                box = [float(file.get(x)) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
                parts = file.get(page.get("Contents"))
                if parts is None and "Contents" in page:
                    raise Bad("contents that are not there")
                parts = parts or []
                content = b"\n".join(unpacked(file.get(p), file.get) for p in (parts if isinstance(parts, list) else [page["Contents"]]))
                held = file.get(page.get("Resources")) or {}
                fonts = {k: font(file, file.get(v)) for k, v in (file.get(held.get("Font")) or {}).items()}
                forms = [k for k, v in (file.get(held.get("XObject")) or {}).items() if isinstance(file.get(v), Stream) and file.get(v).about.get("Subtype") == "Form"]
                problems = [p for f in fonts.values() for p in f.pop("problems")] + ["drawn forms"] * bool(forms) + ["a turned page"] * bool(page.get("Rotate"))
                yield doc, n, box[2] - box[0], box[3] - box[1], content, json.dumps({"origin": box[:2], "fonts": fonts}), "; ".join(dict.fromkeys(problems)) or None
            except (Bad, zlib.error, KeyError, TypeError, ValueError, IndexError, AttributeError) as e:
                yield doc, n, None, None, None, None, str(e) or type(e).__name__
    except (Bad, zlib.error, KeyError, TypeError, ValueError, IndexError, AttributeError, RecursionError) as e:
        yield doc, None, None, None, None, None, str(e) or type(e).__name__


def times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def page_runs(height: float, content: bytes, about: dict, problems: set[str]):
    """Runs (text, box, font, size, bold, italic, block, line) of one page in the order of its operators. Strings of one font and size that follow each other on a base line are one run; a gap of a fifth of the size is a blank, of more than two sizes a new run."""
    fonts = {k: {**f, "texts": {int(c): t for c, t in f["texts"].items()}, "widths": {int(c): w for c, w in f["widths"].items()}} for k, f in about["fonts"].items()}
    one = [1, 0, 0, 1, 0, 0]
    now = {"ctm": one, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
    saved, tm, tlm, held, runs = [], one, one, [], []
    items = Items(content)

    def move(x, y):
        nonlocal tm, tlm
        tlm = times([1, 0, 0, 1, x, y], tlm)
        tm = tlm

    def show(data):
        nonlocal tm
        f = fonts.get(now["font"])
        if f is None:
            problems.add("text without a font")
            return
        scale, text = now["Tz"] / 100, []
        start = times([now["size"] * scale, 0, 0, now["size"], 0, now["Ts"]], times(tm, now["ctm"]))
        for i in range(0, len(data), f["bytes"]):
            code = int.from_bytes(data[i : i + f["bytes"]], "big")
            if code not in f["texts"]:
                problems.add(f"code {code} of {f['name']}")
            text.append(f["texts"].get(code, "�"))
            wide = f["widths"].get(code, f["default"]) / 1000 * now["size"] + now["Tc"] + (now["Tw"] if code == 32 and f["bytes"] == 1 else 0)
            tm = times([1, 0, 0, 1, wide * scale, 0], tm)
        end = times(tm, now["ctm"])
        size = abs(start[0] * start[3] - start[1] * start[2]) ** 0.5
        x0, base, x1 = start[4] - about["origin"][0], height - (start[5] - about["origin"][1]), end[4] - about["origin"][0]
        last, name = (runs[-1] if runs else None), f["name"].split("+")[-1]
        box = (min(x0, x1), base - f["up"] / 1000 * size, max(x0, x1), base - f["down"] / 1000 * size)
        same = last is not None and abs(last["base"] - base) < 0.3 * max(size, last["size"]) and x0 > last["box"][2] - size
        gap = x0 - last["box"][2] if same else 0.0
        if same and last["font"] == name and abs(last["size"] - size) < 0.01 and gap < 2 * size:
            last["text"] += (" " if gap > 0.2 * size and not last["text"].endswith(" ") else "") + "".join(text)
            last["box"] = (min(last["box"][0], box[0]), min(last["box"][1], box[1]), max(last["box"][2], box[2]), max(last["box"][3], box[3]))
            return
        line = last["line"] + (not same) if last else 0
        block = last["block"] + (not same and not 0 <= base - last["base"] <= 1.8 * max(size, last["size"])) if last else 0
        low = name.lower()
        runs.append({"text": "".join(text), "box": box, "base": base, "font": name, "size": size, "bold": bool(f["flags"] & 1 << 18) or "bold" in low or "black" in low or low.endswith("-bd"), "italic": bool(f["flags"] & 1 << 6) or "italic" in low or "oblique" in low, "block": block, "line": line})

    while (x := items.next()) != Word("") or not isinstance(x, Word):
        if not isinstance(x, Word):
            held.append(x)
            continue
        if x == "BI":
            end = content.find(b"EI", items.at)
            items.at = end + 2 if end >= 0 else len(content)
        elif x == "q":
            saved.append(dict(now))
        elif x == "Q" and saved:
            now = saved.pop()
        elif x == "cm":
            now["ctm"] = times(held[-6:], now["ctm"])
        elif x == "BT":
            tm = tlm = one
        elif x == "Tf":
            now["font"], now["size"] = held[-2:]
        elif x in ("Tc", "Tw", "Tz", "TL", "Ts"):
            now[str(x)] = held[-1]
        elif x == "Tm":
            tm = tlm = held[-6:]
        elif x in ("Td", "TD"):
            if x == "TD":
                now["TL"] = -held[-1]
            move(*held[-2:])
        elif x in ("T*", "'", '"'):
            if x == '"':
                now["Tw"], now["Tc"] = held[-3:-1]
            move(0, -now["TL"])
            if x != "T*":
                show(held[-1])
        elif x == "Tj":
            show(held[-1])
        elif x == "TJ":
            for part in held[-1]:
                if isinstance(part, bytes):
                    show(part)
                else:
                    tm = times([1, 0, 0, 1, -part / 1000 * now["size"] * now["Tz"] / 100, 0], tm)
        held = []
    return runs


def table(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pages(found: DataFrame) -> DataFrame:
    """Rows of PAGE from files (path, content); one row with a problem where a file can't be read."""

    names = [f.split()[0] for f in PAGE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.string(), pa.string()]

    def run(batches):
        # Pages leave by the thousand, or as soon as their streams are large.
        rows, size = [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in file_pages(doc, data.as_py() or b""):
                    rows.append(row)
                    size += len(row[4] or b"") + len(row[5] or "")
                    if len(rows) == ROWS or size > LARGE:
                        yield table(rows, kinds, names)
                        rows, size = [], 0
        if rows:
            yield table(rows, kinds, names)

    return found.select("path", "content").mapInArrow(run, PAGE)


def page_texts(pages_: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of RUN: the runs of every page, blank ones too, and one row without text for each page or file with a problem. Pages are dealt to tasks by themselves."""
    dealt = pages_.repartition(tasks, "doc", "page") if tasks else pages_.repartition("doc", "page")
    names = [f.split()[0] for f in RUN.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        held, last, fonts = [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                problems, runs = {r["problem"]} - {None}, []
                if r["content"] is not None:
                    try:
                        # Pages of equal fonts mostly follow each other.
                        if r["fonts"] != last:
                            last, fonts = None, json.loads(r["fonts"])
                            last = r["fonts"]
                        runs = page_runs(r["height"], r["content"], fonts, problems)
                    except (Bad, KeyError, TypeError, ValueError, IndexError) as e:
                        problems.add(str(e) or type(e).__name__)
                held += [(r["doc"], r["page"], i, x["text"], *x["box"], x["font"], x["size"], x["bold"], x["italic"], x["block"], x["line"], None) for i, x in enumerate(runs)]
                if problems:
                    held.append((r["doc"], r["page"], None, None, *[None] * 4, None, None, None, None, None, None, "; ".join(sorted(problems))))
                if len(held) >= ROWS:
                    yield table(held, kinds, names)
                    held = []
        if held:
            yield table(held, kinds, names)

    return dealt.mapInArrow(run, RUN)


def runs(texts: DataFrame) -> DataFrame:
    """SRC-01: the runs of page_texts() that hold more than white space; a blank run joins the one before it on its line."""
    return merged_blanks(texts.where("text IS NOT NULL").drop("problem"))


def problems(texts: DataFrame) -> DataFrame:
    """Why a file (page null) or page was not read as a whole: doc, page, problem."""
    return texts.where("problem IS NOT NULL").select("doc", "page", "problem")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_texts() of the PDF files of a folder (SRC-02)."""
    return page_texts(pages(files(spark, path)))
