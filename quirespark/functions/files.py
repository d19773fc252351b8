"""Column functions over file names, headers and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions import patterns as P


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def parse_filename(path: Column) -> dict[str, Column]:
    """Author, title and index of ``author#title[#index].ext``; ``valid`` is false and the rest null for other names."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    rx = r"^([^#]+)#([^#]+)(?:#([^#]+))?$"
    part = lambda i: F.trim(F.replace(F.regexp_extract(stem, rx, i), F.lit("_"), F.lit(" ")))
    valid = F.coalesce(stem.rlike(rx) & (F.char_length(part(1)) <= 100) & (F.char_length(part(2)) <= 200), F.lit(False))
    return {"author": F.when(valid, part(1)), "title": F.when(valid, part(2)), "book_index": F.when(valid, F.nullif(part(3), F.lit(""))), "valid": valid}


def book_key(author: Column, title: Column, index: Column) -> Column:
    return F.concat(author, F.lit("#"), title, F.coalesce(F.concat(F.lit("#"), F.nullif(index, F.lit(""))), F.lit("")))


def format_of(name: Column) -> Column:
    return F.when(extension(name).isin("pdf", "epub", "txt"), extension(name)).otherwise("txt")


def mime(fmt: Column) -> Column:
    return F.coalesce(*[F.when(fmt == k, F.lit(v)) for k, v in P.MIME.items()], F.lit("application/octet-stream"))


def printable_share(header: Column) -> Column:
    """Printable bytes among the first 512; null for none."""
    latin = F.decode(F.substring(header, 1, 512), "ISO-8859-1")
    n = F.char_length(latin)
    return F.char_length(F.regexp_replace(latin, r"[^\x09\x0A\x0D\x20-\x7E\x{80}-\x{FF}]", "")) / F.nullif(n, F.lit(0))


def by_magic(header: Column) -> dict[str, Column]:
    """Format and confidence by the first bytes; null and 0 where they tell nothing."""
    h = F.hex(F.substring(header, 1, 4))
    pdf, zipped = h == "25504446", h == "504B0304"
    bom = F.hex(F.substring(header, 1, 3)).eqNullSafe("EFBBBF") | F.hex(F.substring(header, 1, 2)).eqNullSafe("FFFE")
    text = F.coalesce(printable_share(header) > 0.7, F.lit(False))
    return {
        "format": F.when(pdf, "pdf").when(zipped, "epub").when(bom, "txt").when(text, "txt"),
        "confidence": F.when(pdf, 0.95).when(zipped | bom, 0.8).when(text, 0.6).otherwise(0.0),
    }


def decide_format(header: Column, name: Column, size: Column, content_valid: Column) -> dict[str, Column]:
    """Final format, confidence and issues: by bytes, else by name; a mismatch costs a fifth, any invalidity half."""
    m = by_magic(header)
    by_name = format_of(name)
    fmt = F.coalesce(m["format"], by_name)
    limit = F.coalesce(*[F.when(fmt == k, F.lit(v)) for k, v in P.SIZE_LIMITS.items()])
    big, mismatch, bad = size > limit, fmt != by_name, ~content_valid
    c = m["confidence"] * F.when(mismatch, 0.8).otherwise(1.0) * F.when(big | bad, 0.5).otherwise(1.0)
    issues = F.array(F.when(big, "size"), F.when(bad, "content"), F.when(mismatch, "mismatch"))
    return {"format": fmt, "confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6), "issues": F.array_join(F.array_compact(issues), ",")}


def pdf_content(pages: Column, text_length: Column, images: Column) -> dict[str, Column]:
    """Content type of a pdf by its text per page (of the first five) and images, and the coverage in percent."""
    cover = F.least(F.lit(100.0), text_length / F.least(pages, F.lit(5)) / 200 * 100)
    kind = (
        F.when(pages == 0, "empty")
        .when(text_length < 100, F.when(images > 0, "image_based").otherwise("empty"))
        .when(images > 0, F.when(cover > 60, "hybrid").otherwise("image_based"))
        .otherwise("text_based")
    )
    return {"content_type": kind, "coverage": F.when(pages > 0, F.round(cover, 6)).otherwise(0.0)}


def file_type(fmt: Column, content_type: Column) -> dict[str, Column]:
    """The two names of a file's type, which differ for pdfs of text."""
    pipeline = F.when(fmt == "epub", "epub").when(fmt == "txt", "text").when(content_type == "hybrid", "pdf-text-ocr").when(content_type == "image_based", "pdf-ocr").otherwise("pdf-text")
    return {"pipeline_type": pipeline, "manifest_type": F.when(pipeline == "pdf-text", "text").otherwise(pipeline)}


_IMAGE_MARKS = [r"/Type\s*/XObject", r"/Subtype\s*/Image", r"/Filter\s*/DCTDecode", r"/Filter\s*/FlateDecode", r"/Filter\s*/JPXDecode", r"/Width\s+\d+", r"/Height\s+\d+", r"/BitsPerComponent", r"/ColorSpace", r"\bDo\b", r"\bBI\b", r"\bEI\b"]


def image_estimate(content: Column, pages: Column) -> dict[str, Column]:
    """Estimated images of a pdf from its raw bytes: a third of all marks, at least one where there is any."""
    t = F.decode(content, "ISO-8859-1")
    n = sum((F.regexp_count(t, F.lit(p)) for p in _IMAGE_MARKS), F.lit(0))
    est = F.greatest(F.floor(n / 3), F.when(n > 0, 1).otherwise(0)).cast("long")
    last = F.least(pages.cast("long"), est)
    return {"images": est, "image_pages": F.when(last > 0, F.sequence(F.lit(1).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))}


def ocr_required(name: Column) -> Column:
    return extension(name).isin("pdf", "png", "jpg", "jpeg", "tiff", "bmp")


def sanitize(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"\s+", "_"), 1, 255)


def name_characters_valid(name: Column) -> Column:
    return ~name.rlike(r'[<>:"/\\|?*]')


def output_name(pattern: Column, author: Column, title: Column, index: Column, stamp: Column, ext: str) -> Column:
    """``{author}{title}{bookIndex}{timestamp}`` filled at their first occurrence; empty brackets go."""
    out = pattern
    for k, v in (("author", author), ("title", title), ("bookIndex", F.coalesce(index, F.lit(""))), ("timestamp", stamp)):
        at = F.instr(out, "{" + k + "}")
        out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), v, F.substring(out, at + len(k) + 2, F.char_length(out)))).otherwise(out)
    return F.concat(F.replace(out, F.lit("[]"), F.lit("")), F.lit("." + ext))


def decode_bytes(content: Column) -> dict[str, Column]:
    """Text of a plain-text file by its byte order mark, else UTF-8 where valid, else Latin-1; and the encoding."""
    h3, h2 = F.hex(F.substring(content, 1, 3)), F.hex(F.substring(content, 1, 2))
    body = content.cast("string")
    ok = F.call_function("is_valid_utf8", body)
    enc = F.when(h3 == "EFBBBF", "utf8").when(h2 == "FFFE", "utf16le").when(h2 == "FEFF", "utf16be").when(ok, "utf8").otherwise("latin1")
    text = (
        F.when(h3 == "EFBBBF", F.regexp_replace(F.call_function("make_valid_utf8", body), "^\\x{FEFF}", ""))
        .when(h2 == "FFFE", F.regexp_replace(F.decode(content, "UTF-16LE"), "^\\x{FEFF}", ""))
        .when(h2 == "FEFF", F.regexp_replace(F.decode(content, "UTF-16BE"), "^\\x{FEFF}", ""))
        .when(ok, body)
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
    return {"encoding": enc, "text": text}
