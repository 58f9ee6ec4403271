"""Text of uploaded files. Plain text, .docx and .pptx are read with the standard library; what needs a
converter, a page renderer or character recognition goes to a reader that the caller plugs in, and is
refused with a reason where there is none: a refused file is routed to manual review."""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of what is opened, and first bytes of the formats.
MOST_PARTS, MOST_BYTES, MOST_PIXELS = 5000, 100 << 20, 50_000_000
PNG, JPEG, ZIP, OLE = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FURNITURE = {"sldNum", "dt", "hdr", "ftr", "sldImg"}
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

EXTRACTED = "text string, ocr_confidence double, unreadable_images int, skipped_images int, error string"


class Unreadable(Exception):
    """A file that is not what it says, or that cannot be read here."""


def _ole(data: bytes, stream: str) -> bool:
    return data.startswith(OLE) and stream.encode("utf-16-le") in data


SIGNATURES: dict[str, Callable[[bytes], bool]] = {
    ".txt": lambda b: True,
    ".md": lambda b: True,
    ".png": lambda b: b.startswith((PNG, JPEG)),
    ".jpg": lambda b: b.startswith((PNG, JPEG)),
    ".jpeg": lambda b: b.startswith((PNG, JPEG)),
    ".docx": lambda b: b.startswith(ZIP),
    ".pptx": lambda b: b.startswith(ZIP),
    ".pdf": lambda b: b"%PDF-" in b[:1024],
    ".doc": lambda b: _ole(b, "WordDocument") or b.startswith(b"{\\rtf"),
    ".ppt": lambda b: _ole(b, "PowerPoint Document"),
}


def check_signature(data: bytes, ext: str) -> None:
    if not SIGNATURES.get(ext, lambda b: False)(data):
        raise Unreadable(f"that isn't a valid {ext} file")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG, nothing decoded."""
    if data.startswith(PNG):
        return (int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")) if data[12:16] == b"IHDR" and len(data) >= 24 else None
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def check_image(data: bytes) -> tuple[int, int]:
    size = image_size(data)
    if size is None:
        raise Unreadable("could not read that image")
    if size[0] * size[1] > MOST_PIXELS:
        raise Unreadable("that image is too large; resize it to under 50 megapixels")
    return size


class Parts:
    """Parts of an office file, inflated under a common limit of what really comes out."""

    def __init__(self, data: bytes, kind: str):
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            raise Unreadable(f"that isn't a valid {kind} file") from e
        if len(self.archive.infolist()) > MOST_PARTS:
            raise Unreadable("that file has too many parts")
        self.left = MOST_BYTES

    def read(self, name: str) -> bytes | None:
        try:
            with self.archive.open(name) as part:
                data = part.read(self.left + 1)
        except KeyError:
            return None
        except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError) as e:
            raise Unreadable("that file is damaged") from e
        self.left -= len(data)
        if self.left < 0:
            raise Unreadable("that file is too large when unpacked")
        return data

    def xml(self, name: str) -> ElementTree.Element | None:
        data = self.read(name)
        if data is None:
            return None
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise Unreadable("that file is damaged")
        try:
            return ElementTree.fromstring(data)
        except ElementTree.ParseError as e:
            raise Unreadable("that file is damaged") from e

    def relations(self, part: str) -> list[tuple[str, str, str]]:
        """(id, type, target part) of what a part refers to inside the file."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        inside = [r for r in (root if root is not None else []) if r.get("TargetMode") != "External"]
        return [(r.get("Id", ""), r.get("Type", ""), posixpath.normpath(posixpath.join("/", folder, r.get("Target", ""))).lstrip("/")) for r in inside]


def _shape_lines(root: ElementTree.Element | None) -> list[str]:
    """One line a paragraph, breaks inside it kept; furniture of the slide and blank paragraphs left out."""
    if root is None:
        return []
    skipped: set[ElementTree.Element] = set()
    for shape in root.iter(f"{_P}sp"):
        place = next(shape.iter(f"{_P}ph"), None)
        if place is not None and place.get("type") in FURNITURE:
            skipped.update(shape.iter(f"{_A}p"))
    lines = []
    for paragraph in root.iter(f"{_A}p"):
        if paragraph in skipped:
            continue
        line = "".join("\n" if e.tag == f"{_A}br" else "".join(e.itertext()) for e in paragraph.iter() if e.tag in (f"{_A}br", f"{_A}t"))
        if line.strip():
            lines.append(line)
    return lines


Pictures = list[tuple[bytes, int]]


def _pictures(parts: Parts, relations: list[tuple[str, str, str]], place: int) -> Pictures:
    """(content, place) of the pictures that a part shows; one that is not in the file is empty."""
    return [(parts.read(target) or b"", place) for _, kind, target in relations if kind.endswith("/image")]


def read_pptx(data: bytes) -> tuple[str, Pictures]:
    """Slides in the order of the presentation, each with its notes; the pictures."""
    parts = Parts(data, ".pptx")
    root = parts.xml("ppt/presentation.xml")
    if root is None:
        raise Unreadable("that isn't a valid .pptx file")
    targets = {i: t for i, _, t in parts.relations("ppt/presentation.xml")}
    slides, pictures = [], []
    for entry in root.iter(f"{_P}sldId"):
        path = targets.get(entry.get(f"{_R}id", ""))
        if path is None:
            continue  # a reference to nothing is no slide
        relations = parts.relations(path)
        pictures += _pictures(parts, relations, len(slides))
        notes = next((t for _, kind, t in relations if kind.endswith("/notesSlide")), None)
        body = _shape_lines(parts.xml(path))
        said = _shape_lines(parts.xml(notes)) if notes else []
        slides.append("\n".join([f"Slide {len(slides) + 1}:", *body, *(["Notes:", *said] if said else [])]))
    return "\n\n".join(slides), pictures


def read_docx(data: bytes) -> tuple[str, Pictures]:
    """Paragraphs, a blank line between them; the pictures."""
    parts = Parts(data, ".docx")
    root = parts.xml("word/document.xml")
    if root is None:
        raise Unreadable("that isn't a valid .docx file")
    written = {f"{_W}t": None, f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    paragraphs = ["".join((e.text or "") if written[e.tag] is None else written[e.tag] for e in p.iter() if e.tag in written) for p in root.iter(f"{_W}p")]
    return "\n\n".join(paragraphs), _pictures(parts, parts.relations("word/document.xml"), 0)


def without_links(data: bytes, kind: str = ".docx") -> bytes:
    """An office file that loads nothing from outside: external references but hyperlinks go, fields that include files are disarmed."""
    parts, out = Parts(data, kind), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for entry in parts.archive.infolist():
            body = parts.read(entry.filename)
            if entry.filename.endswith(".rels"):
                root = parts.xml(entry.filename)
                for r in [r for r in root if r.get("TargetMode") == "External" and not r.get("Type", "").endswith("/hyperlink")]:
                    root.remove(r)
                body = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            elif entry.filename.endswith(".xml"):
                body = re.sub(rb"(?i)INCLUDE(PICTURE|TEXT)", rb"IGNORED\1", body)
            target.writestr(entry.filename, body)
    return out.getvalue()


def is_blank(pixels: bytes, channels: int = 4) -> bool:
    """Whether a page of raw pixels has (almost) no ink: under 0.2 % of pixels darker than 480 in all."""
    import numpy as np

    rgb = np.frombuffer(pixels, np.uint8).reshape(-1, channels)[:, :3]
    return int((rgb.sum(1, dtype=np.int64) < 480).sum()) < 0.002 * len(rgb)


def distinct_pictures(pictures: list[tuple[bytes, int]], most: int = 20) -> list[tuple[bytes, int, int]]:
    """(content, first place, uses) of PNG and JPEG pictures over 100 pixels, each once, ``most`` at most to be read."""
    seen: dict[bytes, list] = {}
    for content, place in pictures:
        size = image_size(content) if content.startswith((PNG, JPEG)) else None
        if size is not None and max(size) > 100:
            seen.setdefault(content, [place, 0])[1] += 1
    return [(c, place, uses) for c, (place, uses) in list(seen.items())[:most]]


_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\ufeff]")
_EDGE = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def clean(text: str) -> str:
    import regex

    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).replace("\r\n", "\n").replace("\r", "\n")
    text = regex.sub(r"(\p{L})-\n(\p{Ll})", r"\1\2", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(_EDGE)


Reader = Callable[[bytes, str], dict]


# What is a picture of writing, and what is a logo.
LEAST_WORDS, LEAST_CONFIDENCE, LOGO_PIXELS = 2, 75, 400


def picture_verdict(found: dict, uses: int, longer_side: int) -> str:
    """What becomes of a picture that was read."""
    import regex

    said = found.get("text") or ""
    words = len(regex.findall(r"[\p{L}\p{N}]{2,}", said))
    tokens = said.split()
    written = sum(bool(regex.fullmatch(r"[\p{L}'’]{3,}[.,;:!?]?", t)) for t in tokens)
    if words >= LEAST_WORDS and (found.get("ocr_confidence") or 0) >= LEAST_CONFIDENCE:
        return "kept"
    if words < LEAST_WORDS and (uses > 1 or longer_side <= LOGO_PIXELS):
        return "dropped"
    return "unreadable" if written >= 10 and 2 * written >= len(tokens) else "skipped"


def with_pictures(text: str, pictures: Pictures, reader: Reader | None) -> dict:
    """A text with that of its pictures at its end, the least confidence of what was kept, and counts of what was not."""
    kept, counts, confidence = [text], {"unreadable": 0, "skipped": 0, "dropped": 0, "kept": 0}, []
    counts["skipped"] += len({content for content, _ in pictures if not content.startswith((PNG, JPEG))})
    shown = distinct_pictures(pictures, most=len(pictures))
    for number, (content, _, uses) in enumerate(shown):
        if reader is None or number >= MOST_PICTURES:
            counts["skipped"] += 1
            continue
        try:
            check_image(content)
            found = reader(content, ".png" if content.startswith(PNG) else ".jpg")
        except Unreadable:
            counts["skipped"] += 1
            continue
        verdict = picture_verdict(found, uses, max(image_size(content)))
        counts[verdict] += 1
        if verdict == "kept":
            kept.append(found["text"].strip())
            confidence.append(float(found["ocr_confidence"]))
    joined = clean("\n\n".join(x for x in kept if x.strip()))
    return {"text": joined, "ocr_confidence": min(confidence, default=None), "unreadable_images": counts["unreadable"], "skipped_images": counts["skipped"]}


#: Pictures of one document that are read.
MOST_PICTURES = 20


def extract(data: bytes, ext: str, reader: Reader | None = None) -> dict:
    """Text and image counts of one file; pictures inside an office file go to the reader, or count as skipped without one.

    Office files are read without what they would load from outside.
    """
    check_signature(data, ext)
    if ext in (".txt", ".md"):
        return with_pictures(data.decode("utf-8", "replace"), [], reader)
    if ext in (".docx", ".pptx"):
        return with_pictures(*(read_docx if ext == ".docx" else read_pptx)(without_links(data, ext)), reader)
    if ext in (".png", ".jpg", ".jpeg"):
        check_image(data)
    if reader is None:
        raise Unreadable(f"{ext} files can't be read here")
    found = reader(data, ext)
    return {"ocr_confidence": None, "unreadable_images": 0, "skipped_images": 0} | found | {"text": clean(found.get("text", ""))}


def extracted(files: DataFrame, reader: Reader | None = None) -> DataFrame:
    """``files`` (file, content) with EXTRACTED columns; equal files are read once and joined back.

    A file that cannot be read has an error and no text; it never fails the query. Files are read one by
    one, so that memory is bounded by the largest.
    """
    keyed = files.withColumn("ext", F.lower(F.regexp_extract("file", r"[^/.](\.[^./]*)\z", 1))).withColumn("digest", F.sha2(F.col("content"), 256))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, ext, content in zip(frame["digest"], frame["ext"], frame["content"], strict=True):
                try:
                    found = extract(bytes(content), ext, reader) | {"error": None}
                    if not found["text"]:
                        found["error"] = "the submission has no readable text (if it's a scan, try a clearer image)"
                except Unreadable as e:
                    found = {"text": None, "ocr_confidence": None, "unreadable_images": 0, "skipped_images": 0, "error": str(e)}
                rows.append({"read_digest": digest, "read_ext": ext} | found)
            yield pd.DataFrame(rows, columns=["read_digest", "read_ext", "text", "ocr_confidence", "unreadable_images", "skipped_images", "error"])

    distinct = keyed.select("digest", "ext", "content").dropDuplicates(["digest", "ext"])
    read = distinct.mapInPandas(run, f"read_digest string, read_ext string, {EXTRACTED}")
    same = F.col("digest").eqNullSafe(F.col("read_digest")) & F.col("ext").eqNullSafe(F.col("read_ext"))
    return keyed.drop("content").join(read, same, "left").drop("read_digest", "read_ext", "digest")
