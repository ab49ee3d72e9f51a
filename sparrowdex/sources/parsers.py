"""Readers of single files, with the standard library only."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

#: The language of a code file's fence.
LANGUAGE = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c",
    ".cpp": "cpp", ".h": "c", ".rb": "ruby", ".php": "php", ".sh": "bash", ".sql": "sql", ".r": "r", ".swift": "swift", ".kt": "kotlin",
}


class Unreadable(ValueError):
    """The file can't be turned into text."""


def name_of(path: str) -> str:
    return re.split(r"[/\\]", path)[-1]


def suffix(path: str) -> str:
    m = re.search(r".(\.[^.]*)$", name_of(path))
    return m.group(1).lower() if m else ""


def strip_html(html: str) -> str:
    bare = re.sub(r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ", html)
    return " ".join(re.sub(r"<[^>]+>", " ", bare).split())


def strip_xml(xml: str) -> str:
    return " ".join(re.sub(r"<[^>]+>", " ", xml).split())


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Unreadable("not an archive of its kind") from e


def docx(data: bytes) -> str:
    root = ElementTree.fromstring(_zip(data).read("word/document.xml"))
    out = []
    for p in root.iter():
        if _local(p.tag) == "p":
            out.append("".join({"t": n.text or "", "tab": "\t", "br": "\n"}.get(_local(n.tag), "") for n in p.iter()))
    return "\n\n".join(out).strip()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref).group(0):
        n = n * 26 + ord(c) - 64
    return n - 1


def _csv(cells: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\n\r]', c) else c for c in cells)


def xlsx(data: bytes, name: str) -> str:
    """Sheets as comma-separated lines without blank rows, each under its name."""
    z = _zip(data)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    parts = [f"[Spreadsheet: {name}]"]
    for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(s.tag) != "sheet":
            continue
        target = rels[next(v for k, v in s.attrib.items() if _local(k) == "id")].lstrip("/")
        rows = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
            if _local(row.tag) != "row":
                continue
            cells: list[str] = []
            for c in row:
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                value = next((n.text or "" for n in c if _local(n.tag) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(n.text or "" for n in c.iter() if _local(n.tag) == "t")
                cells += [""] * (at - len(cells)) + [value or ""]
            if any(x.strip() for x in cells):
                rows.append(_csv(cells))
        parts.append(f"[Sheet: {s.get('name')}]\n" + ("\n".join(rows) or "(empty)"))
    return "\n\n".join(parts)


def pptx(data: bytes) -> str:
    z = _zip(data)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group(0)))
    out = []
    for n in slides:
        paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in ElementTree.fromstring(z.read(n)).iter() if _local(p.tag) == "p"]
        out.append("\n".join(p for p in paragraphs if p.strip()))
    return "\n\n".join(x for x in out if x)


def odf(data: bytes) -> str:
    root = ElementTree.fromstring(_zip(data).read("content.xml"))
    out = []
    for n in root.iter():
        if _local(n.tag) in ("p", "h"):
            out.append("".join(n.itertext()))
    return "\n".join(x for x in out if x.strip())


def rtf(data: bytes) -> str:
    """Text of the document's body: groups of fonts, colours, styles and pictures are left out."""
    text = data.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise Unreadable("not RTF")
    out, stack, skip, bytes_after = [], [], False, 1
    pattern = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}]+)", re.I)
    drop = 0
    for m in pattern.finditer(text):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or (word in ("fonttbl", "colortbl", "stylesheet", "pict", "info", "generator")):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "sect", "page"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "uc":
            bytes_after = int(number or 1)
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            drop = bytes_after
        elif code:
            if drop:
                drop -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign and sign in "\\{}~":
            out.append(" " if sign == "~" else sign)
        elif plain:
            body = plain.replace("\r", "").replace("\n", "")
            cut = min(drop, len(body))
            drop -= cut
            out.append(body[cut:])
    return strip_html("".join(out))


def epub(data: bytes) -> str:
    """Chapters in the order of the spine; unreadable ones are skipped."""
    z = _zip(data)
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(n.get("full-path") for n in container.iter() if _local(n.tag) == "rootfile")
    package = ElementTree.fromstring(z.read(opf))
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {n.get("id"): n.get("href") for n in package.iter() if _local(n.tag) == "item"}
    out = []
    for ref in (n.get("idref") for n in package.iter() if _local(n.tag) == "itemref"):
        try:
            chapter = strip_html(z.read(base + items[ref]).decode("utf-8", "replace"))
        except KeyError:
            continue
        if chapter:
            out.append(chapter)
    return "\n\n---\n\n".join(out)


def gltf(model: dict, name: str) -> str:
    """Outline of a 3D model."""
    lines = [f"[3D Model: {name}]"]
    asset = model.get("asset", {})
    for k in ("version", "generator", "copyright"):
        if asset.get(k):
            lines.append(f"{k}: {asset[k]}")
    for k in ("scenes", "nodes", "meshes", "materials", "textures", "images", "animations", "skins", "cameras"):
        held = model.get(k) or []
        if held:
            names = [str(x.get("name")) for x in held if isinstance(x, dict) and x.get("name")]
            lines.append(f"{k}: {len(held)}" + (f" ({', '.join(names[:20])})" if names else ""))
    return "\n".join(lines)


def glb(data: bytes, name: str) -> str:
    if len(data) < 20 or data[:4] != b"glTF":
        raise Unreadable("not a binary glTF file")
    length, kind = struct.unpack_from("<II", data, 12)
    if kind != 0x4E4F534A:
        raise Unreadable("its first chunk isn't JSON")
    return gltf(json.loads(data[20 : 20 + length].decode("utf-8")), name)


def _pdf_string(raw: bytes) -> str:
    out = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(m.group(1), m.group(1)) if not m.group(1).isdigit() else bytes([int(m.group(1), 8) & 255]), raw)
    return out.decode("utf-16-be", "replace") if out[:2] == b"\xfe\xff" else out.decode("latin-1")


def _pdf_text(stream: bytes) -> str:
    out = []
    for m in re.finditer(rb"\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ|\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|(T\*|Td|TD|ET)\b", stream):
        if m.group(1) is not None:
            for part in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)", m.group(1)):
                out.append(_pdf_string(part.group(1)) if part.group(1) is not None else (" " if float(part.group(2)) < -200 else ""))
        elif m.group(2) is not None:
            out.append(_pdf_string(m.group(2)))
        else:
            out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def pdf_pages(data: bytes) -> list[str]:
    """Text layer by page, for plain and deflated streams with simple fonts."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise Unreadable("not a PDF file")
    objects = {int(m.group(1)): m.group(2) for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}

    def stream(number: int) -> bytes:
        body = objects.get(number, b"")
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        if b"FlateDecode" in body[: m.start()]:
            try:
                return zlib.decompressobj().decompress(m.group(1))
            except zlib.error:
                return b""
        return m.group(1)

    refs = lambda body, name: [int(x) for m in [re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)] if m for x in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1))]
    kind = {n: bool(re.search(rb"/Type\s*/Page\b(?!s)", body)) for n, body in objects.items()}
    # in the order of the tree of pages; pages that it doesn't reach come last, by number
    order: dict[int, None] = {}
    roots = [r for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) for r in refs(body, b"Pages")]
    todo, seen = roots[::-1], set()
    while todo:
        n = todo.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if kind[n]:
            order[n] = None
        todo += refs(objects[n], b"Kids")[::-1]
    order |= dict.fromkeys(n for n in sorted(objects) if kind[n])
    return [_pdf_text(b"\n".join(stream(r) for r in refs(objects[n], b"Contents"))) for n in order]


def split_pages(pages: list, size: int) -> list[list]:
    """Segments of up to ``size`` pages."""
    if size < 1:
        raise ValueError("a segment has one page at least")
    return [pages[i : i + size] for i in range(0, len(pages), size)]


def blocks_from_markdown(markdown: str, page: int) -> list[dict]:
    """Blocks of a page in reading order: text, and figures by their references, whose ids name the page."""
    out, at = [], 0
    for m in re.finditer(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", markdown):
        before = markdown[at : m.start()].strip()
        if before:
            out.append({"kind": "text", "id": None, "text": before})
        out.append({"kind": "figure", "id": f"p{page}-{m.group(1)}", "text": None})
        at = m.end()
    rest = markdown[at:].strip()
    return [*out, {"kind": "text", "id": None, "text": rest}] if rest else out


def caption_near(markdown: str, image: str, reach: int = 3) -> str | None:
    """The caption within some lines of an image's reference."""
    lines = markdown.split("\n")
    at = next((i for i, x in enumerate(lines) if f"({image}" in x), None)
    if at is None:
        return None
    for d in range(1, reach + 1):
        for i in (at + d, at - d):
            if 0 <= i < len(lines) and re.match(r"(?i)\W*(gambar|tabel|grafik|diagram|foto|bagan|ilustrasi|peta|figure|fig\.|table|chart)\b", lines[i].strip()):
                return lines[i].strip().strip("*_ ")
    return None


def type_from_caption(caption: str | None) -> str:
    c = (caption or "").lower()
    if re.match(r"\W*(tabel|table)\b", c):
        return "table"
    if re.match(r"\W*(grafik|diagram|bagan|chart|graph)\b", c):
        return "chart"
    return "image" if re.match(r"\W*(foto|photo)\b", c) else "figure"


def normalised_box(box: tuple[float, float, float, float], width: float, height: float) -> tuple[float, ...]:
    """A box as parts of the page, within 0 and 1."""
    scale = (width, height, width, height)
    return tuple(min(1.0, max(0.0, b / s)) if s else 0.0 for b, s in zip(box, scale, strict=True))


def layout_response(reply: dict) -> dict:
    """A layout service's answer in one form, whatever fields it left out."""
    pages = reply.get("pages_text") or []
    page_map = [{"page": i, "text": p} if isinstance(p, str) else {"page": int(p.get("page", i)), "text": p.get("text", "")} for i, p in enumerate(pages)]
    figures = [{"type": f.get("type", "figure"), "page": int(f.get("page", 0)), "caption": f.get("caption") or None, "id": f.get("id")} for f in reply.get("figures") or []]
    return {"text": reply.get("text", ""), "ms": int(reply.get("ms") or 0), "pages": reply.get("pages"), "page_map": page_map, "figures": figures, "pages_blocks": reply.get("pages_blocks") or []}


def strip_fence(text: str) -> str:
    m = re.fullmatch(r"\s*```[\w-]*\n(.*?)\n?```\s*", text, re.S)
    return m.group(1) if m else text.strip()


# -- merging ---------------------------------------------------------------------------------------------


def structural_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text) of a structural extraction: html, table, heading, code, latex, prose, blank; joined by newlines they are the text again."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        s, start, kind = lines[i].strip(), i, "prose"
        if not s:
            kind = "blank"
        elif s.lower().startswith("<table"):
            kind = "html"
            while i < len(lines) - 1 and "</table>" not in lines[i].lower():
                i += 1
            if i + 1 < len(lines) and lines[i + 1].strip().lower() == "</div>":
                i += 1
        elif s.startswith("|") and i + 1 < len(lines) and lines[i + 1].strip().startswith("|"):
            kind = "table"
            while i + 1 < len(lines) and lines[i + 1].strip().startswith("|"):
                i += 1
        elif re.match(r"#{1,6}\s", s):
            kind = "heading"
        elif s.startswith("```"):
            kind = "code"
            while i + 1 < len(lines):
                i += 1
                if lines[i].strip().startswith("```"):
                    break
        elif s.startswith("$$"):
            kind = "latex"
            while not (lines[i].strip().endswith("$$") and (i > start or len(s) > 2)) and i + 1 < len(lines):
                i += 1
        else:
            while i + 1 < len(lines) and lines[i + 1].strip() and not re.match(r"\s*(#{1,6}\s|```|\$\$|\||<table)", lines[i + 1], re.I):
                i += 1
        out.append((kind, "\n".join(lines[start : i + 1])))
        i += 1
    return out


def merge_structural(structural: str, layer: str, *, anchor: int = 5, low: float = 0.7, high: float = 1.5) -> str:
    """The structural text with its prose replaced by the text layer's wording.

    A prose block is found in the text layer by its first and last five words; the span between is taken if its length is within the bounds. Tables,
    headings, code and formulas stay as they are. If one side is empty it is the other.
    """
    if not structural.strip():
        return layer
    if not layer.strip():
        return structural
    flat = " ".join(layer.split())
    low_flat = flat.lower()
    out = []
    for kind, block in structural_blocks(structural):
        words = block.split()
        if kind == "prose" and len(words) >= 2 * anchor:
            head, tail = " ".join(words[:anchor]).lower(), " ".join(words[-anchor:]).lower()
            a = low_flat.find(head)
            z = low_flat.find(tail, a + len(head)) if a >= 0 else -1
            if z >= 0:
                span = flat[a : z + len(tail)]
                if low <= len(span) / max(1, len(" ".join(words))) <= high:
                    block = span
        out.append(block)
    return "\n".join(out)


# -- truncated JSON ----------------------------------------------------------------------------------------


def repair_json(reply: str):
    """The value in a model's reply: as it stands, cut at its end and closed, or the complete objects in it; None without any."""
    body = strip_fence(reply or "")
    starts = [i for i in (body.find("{"), body.find("[")) if i >= 0]
    if not starts:
        return None
    body = body[min(starts) :]
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        pass
    stack, string, escaped, cuts = [], False, False, []
    for i, c in enumerate(body):
        if string:
            escaped = c == "\\" and not escaped
            if c == '"' and not escaped:
                string = False
            continue
        escaped = False
        if c == '"':
            string = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            cuts.append((i + 1, list(stack)))
    for at, open_ in reversed(cuts[-200:]):
        try:
            return json.loads(body[:at] + "".join(reversed(open_)))
        except ValueError:
            continue
    found = []
    for m in re.finditer(r"\{[^{}]*\}", body):
        try:
            found.append(json.loads(m.group(0)))
        except ValueError:
            continue
    return found or None


# -- dispatch ------------------------------------------------------------------------------------------------


def extract_one(path: str, data: bytes, ocr: Callable[[bytes, str], str] | None = None, kind: str | None = None) -> tuple:
    """(path, text, pages, error) of one file, by ``kind`` (the extension that its media type stands for) or else its own extension; unknown ones are read as UTF-8."""
    ext, name, pages = kind or suffix(path), name_of(path), None
    try:
        if ext == ".pdf":
            texts = pdf_pages(data)
            text = "\n\n".join(t for t in texts if t)
            pages = [{"page": i + 1, "text": t} for i, t in enumerate(texts) if t]
            if sum(len("".join(t.split())) for t in texts) < 100 * max(1, len(texts)) and ocr is not None:
                text, pages = ocr(data, name), None
            if not text.strip():
                raise Unreadable("no text layer and no reader for scans")
        elif ext in (".png", ".jpg", ".jpeg", ".gif", ".webp", ".heic"):
            if ocr is None:
                raise Unreadable("no reader for images")
            text = f"[Image: {name}]\n\n{ocr(data, name)}"
        elif ext == ".docx":
            text = docx(data)
        elif ext == ".xlsx":
            text = xlsx(data, name)
        elif ext == ".pptx":
            text = pptx(data)
        elif ext in (".odt", ".ods"):
            text = odf(data)
        elif ext in (".doc", ".xls", ".ppt"):
            raise Unreadable("binary office formats need a converter")
        elif ext == ".rtf":
            text = rtf(data)
        elif ext == ".epub":
            text = epub(data)
        elif ext == ".gltf":
            text = gltf(json.loads(data.decode("utf-8")), name)
        elif ext == ".glb":
            text = glb(data, name)
        else:
            text = data.decode("utf-8", "replace").replace("\0", "")
            if ext in (".html", ".htm"):
                text = strip_html(text)
            elif ext == ".xml":
                text = strip_xml(text)
            elif ext in LANGUAGE:
                text = f"[Code: {name}]\n\n```{LANGUAGE[ext]}\n{text}\n```"
        return path, text, pages, None
    except Exception as e:  # noqa: BLE001 - one file's fault is a row, not the job's end
        return path, None, None, f"{type(e).__name__}: {e}"
