"""Files: formats, catalog rows, e-mail, HTML, subtitles and tables of text."""

from __future__ import annotations

import csv
import html
from email import policy
from email.parser import BytesParser
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.functions import text
from corpusforge.session import small_batches

# File extensions by how they are read.
NATIVE = ".pdf .docx .xlsx .pptx .html .htm .md .adoc .asciidoc .csv .tex .vtt .png .jpg .jpeg .tif .tiff .bmp .webp .xml .json".split()
CONVERTIBLE = {
    "email": ".eml .msg".split(),
    "office": ".doc .xls .ppt .odt .ods .odp .rtf".split(),
    "text": ".txt .log .rst".split(),
    "media": ".mp3 .wav .m4a .flac .ogg .mp4 .avi .mov .mkv .webm".split(),
}


def formats(spark: SparkSession) -> DataFrame:
    """(extension, route) of every supported format, sorted."""
    rows = [(e, "native") for e in NATIVE] + [(e, route) for route, each in CONVERTIBLE.items() for e in each]
    return spark.createDataFrame(sorted(rows), "extension string, route string")


def extension(name: str | Column) -> Column:
    return F.lower(F.regexp_extract(text.col(name), r"[^/.](\.[^./]*)$", 1))


def route(name: str | Column) -> Column:
    """native, email, office, text, media, or unsupported."""
    e = extension(name)
    out = F.when(e.isin(NATIVE), "native")
    for kind, each in CONVERTIBLE.items():
        out = out.when(e.isin(each), kind)
    return out.otherwise("unsupported")


def within_duration(seconds: str, most: float) -> Column:
    """The cap on the length of media that is transcribed."""
    return F.col(seconds).isNotNull() & (F.col(seconds) <= most)


def read_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 512 << 20) -> DataFrame:
    """(file_id, filename, bytes, content_hash, content): a row for each file within the size cap."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).filter(F.col("length") <= max_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.concat(F.lit("file-"), F.substring(F.sha2("path", 256), 1, 12)).alias("file_id"), name.alias("filename"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"), "content")


def admit_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 512 << 20) -> DataFrame:
    """(file_id, filename, bytes, reason): every file below a path that has a byte, and why one isn't taken.

    ``reason`` is null for those that are read: others are over the size or of an unsupported
    kind. No content is read. Spark's file sources don't list files of no bytes; a job for
    one fails by ``catalog``'s guards.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    why = F.when(F.col("bytes") > max_bytes, "too large").when(route("filename") == "unsupported", "unsupported")
    rows = raw.select(F.concat(F.lit("file-"), F.substring(F.sha2("path", 256), 1, 12)).alias("file_id"), name.alias("filename"), F.col("length").alias("bytes"))
    return rows.withColumn("reason", why)


@F.pandas_udf(T.StringType())
def whole_text(content: pd.Series) -> pd.Series:
    """The bytes of a text file as text: by its byte order mark, as UTF-8, or else as Windows-1252."""

    def one(raw):
        if raw is None:
            return None
        raw = bytes(raw)
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if raw.startswith(mark):
                return raw.decode(name, "replace")
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return raw.decode("cp1252", "replace")

    return content.map(one)


def read_texts(spark: SparkSession, path: str, max_bytes: int = 512 << 20) -> DataFrame:
    """(file_id, filename, text): the whole text of every text file below a path."""
    rows = read_files(spark, path, max_bytes=max_bytes)
    return rows.filter(route("filename") == "text").select("file_id", "filename", F.regexp_replace(whole_text("content"), "\r\n?", "\n").alias("text"))


def list_files(files: DataFrame, purpose: str | None = None) -> DataFrame:
    """The catalog, newest first."""
    rows = files if purpose is None else files.filter(F.col("purpose") == purpose)
    return rows.orderBy(F.desc("created_at"), "file_id")


# --- e-mail and HTML -------------------------------------------------------


def _email_html(raw: bytes) -> str:
    message = BytesParser(policy=policy.default).parsebytes(bytes(raw))
    fields = "".join(f"<p><b>{label}:</b> {html.escape(str(message[name]))}</p>" for label, name in (("Oggetto", "subject"), ("Da", "from"), ("A", "to"), ("Data", "date")) if message[name])
    body = message.get_body(("html",))
    if body is not None:
        return f"<html><body>{fields}{body.get_content()}</body></html>"
    plain = message.get_body(("plain",))
    return f"<html><body>{fields}<pre>{html.escape(plain.get_content() if plain is not None else '')}</pre></body></html>"


@F.pandas_udf(T.StringType())
def email_html(content: pd.Series) -> pd.Series:
    """An e-mail as HTML: a head of fields, then its HTML part or else its text."""
    return content.map(lambda raw: None if raw is None else _email_html(raw))


def outlook_html(content) -> Column:
    raise NotImplementedError("Outlook .msg files need a converter that isn't part of this package")


class _Blocks(HTMLParser):
    """Text blocks with the headings above them; scripts, styles and navigation don't count."""

    SILENT = {"script", "style", "nav", "footer", "head", "noscript", "template"}
    BLOCK = {"p", "li", "td", "th", "pre", "blockquote", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "ul", "ol", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.silent, self.title, self.level = 0, None, 0
        self.headings: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.blocks: list[dict] = []

    def _end_block(self):
        words = " ".join("".join(self.buffer).split())
        self.buffer = []
        if not words:
            return
        if self.level:
            self.headings = [(n, t) for n, t in self.headings if n < self.level] + [(self.level, words)]
        else:
            self.blocks.append({"headings": [t for _, t in self.headings], "text": words})

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag in self.BLOCK:
            self._end_block()
            self.level = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else 0
        elif tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in self.BLOCK:
            self._end_block()
            self.level = 0

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append(data)

    def close(self):
        super().close()
        self._end_block()
        return self.blocks


def _blocks(page: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(page or "")
    return parser.close()


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])))
def html_blocks(page: pd.Series) -> pd.Series:
    return page.map(_blocks)


def html_sections(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(file_id, chunk_index, headings, text) of the blocks of each page."""
    small_batches(pages.sparkSession)  # pages are long
    blocks = pages.select(F.col(key).alias("file_id"), F.posexplode(html_blocks(column)).alias("chunk_index", "b"))
    return blocks.select("file_id", "chunk_index", "b.headings", "b.text")


# --- subtitles, text and chunks --------------------------------------------


def vtt_text(c: str | Column) -> Column:
    """Subtitles without the header, cue times and blank lines, on one line."""
    lines = F.transform(F.split(F.coalesce(text.col(c), F.lit("")), "\r?\n"), F.trim)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("WEBVTT")) & ~F.contains(x, F.lit("-->"))), " ")


def line_chunks(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(file_id, chunk_index, text): the lines of each text that aren't blank."""
    parts = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), "\n"), lambda x: text.strip(x) != "")
    return docs.select(F.col(key).alias("file_id"), F.posexplode(parts).alias("chunk_index", "text"))


def heading_chunks(docs: DataFrame, key: str = "doc_id", column: str = "text", max_tokens: int = 512) -> DataFrame:
    """(file_id, chunk_index, headings, text): markdown cut at headings and by size.

    Lines under one heading are packed into chunks of at most ``max_tokens`` words
    (a longer line is split); a chunk never joins two headings. The text begins
    with its headings, a line each.
    """
    schema = f"file_id {dict(docs.dtypes)[key]}, chunk_index int, headings array<string>, text string"

    def cut(batches):
        for pdf in batches:
            out = []
            for ident, value in zip(pdf[key], pdf[column], strict=True):
                path: list[tuple[int, str]] = []
                held: list[str] = []
                n = 0

                def flush():
                    nonlocal held, n
                    if held:
                        titles = [t for _, t in path]
                        out.append((ident, n, titles, "\n".join([*titles, " ".join(held)])))
                        held, n = [], n + 1

                for line in (value or "").split("\n"):
                    mark = len(line) - len(line.lstrip("#"))
                    if 1 <= mark <= 6 and line[mark : mark + 1] == " ":
                        flush()
                        path = [(m, t) for m, t in path if m < mark] + [(mark, line[mark:].strip())]
                        continue
                    for word in line.split():
                        if len(held) >= max_tokens:
                            flush()
                        held.append(word)
                flush()
            yield pd.DataFrame(out, columns=["file_id", "chunk_index", "headings", "text"])

    return docs.select(key, column).mapInPandas(cut, schema)


# --- tables of text --------------------------------------------------------


def sniff(sample: bytes) -> tuple[str, str, str]:
    """(encoding, delimiter, decimal) from the first bytes of a table."""
    try:
        encoding, value = "UTF-8", sample.decode("utf-8")
    except UnicodeDecodeError:
        encoding, value = "ISO-8859-1", sample.decode("latin-1")
    try:
        delimiter = csv.Sniffer().sniff(value, delimiters=";,\t|").delimiter
    except csv.Error:
        first = next((line for line in value.splitlines() if line.strip()), "")
        delimiter = max(";,\t|", key=first.count) if first else ","
    return encoding, delimiter, "," if delimiter == ";" else "."


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """A CSV as text columns, broken lines skipped; and its decimal sign.

    The dialect comes from the first 64 KB; the table itself is never sampled.
    """
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("head")).first()["head"]
    encoding, delimiter, decimal = sniff(bytes(head))
    df = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, encoding=encoding, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True)
    return df.fillna(""), decimal


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, spans) of a JSON-lines training set in either of its two formats.

    ``{text, entities: [[string, label]]}`` is tokenised and its entities looked
    up (the first place counts); ``{tokenized_text, ner: [[start, end, label]]}``
    is taken as it is.
    """
    from corpusforge.operators.entities import token_span, word_tokens

    schema = "text string, entities array<array<string>>, tokenized_text array<string>, ner array<array<string>>"
    rows = spark.read.schema(schema).json(path)
    words = F.coalesce("tokenized_text", word_tokens("text"))
    found = F.transform(F.coalesce("entities", F.expr("CAST(array() AS array<array<string>>)")), lambda e: F.struct(token_span(words, word_tokens(e[0])).alias("span"), e[1].alias("label")))
    looked_up = F.transform(F.filter(found, lambda s: s["span"].isNotNull()), lambda s: F.struct(s["span"]["start"].alias("start"), s["span"]["end"].alias("end"), s["label"].alias("label")))
    given = F.transform("ner", lambda e: F.struct(e[0].cast("int").alias("start"), e[1].cast("int").alias("end"), e[2].alias("label")))
    return rows.select(words.alias("tokens"), F.coalesce(given, looked_up).alias("spans"), (F.size(found) - F.size(looked_up)).alias("missed"))
