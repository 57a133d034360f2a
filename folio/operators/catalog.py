"""Work plans, retries, jobs and the library's catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import human_size, is_safe_member
from folio.operators.folds import sorted_fold

# What an error says that no retry mends; the base of the waiting times; the kinds of books.
TERMINAL_ERROR = "drm|not a valid|malformed|not found"
BACKOFF = 5
BOOKS = (".pdf", ".epub")
# Notes of the catalog.
PARTLY, REBUILT, USELESS = ("text layer partially rebuilt via OCR; ", " section(s) may remain unselectable"), "text layer rebuilt via OCR", "OCR attempted but failed; text layer may be unusable"


def chunk_plan(items: DataFrame, size: int = 50) -> DataFrame:
    """(doc_id, chunk, n_items, first_pos): slices of a document's items (doc_id, pos); one slice if size is 0 or all fit in one."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    chunk = F.when((n <= size) | F.lit(size <= 0), 0).otherwise(F.floor(F.col("pos") / max(size, 1))).cast("int")
    return items.withColumn("chunk", chunk).groupBy("doc_id", "chunk").agg(F.count("*").alias("n_items"), F.min("pos").alias("first_pos"))


def retry_schedule(chunks: DataFrame, retries: int = 2) -> DataFrame:
    """One row per possible attempt: its timeout grows with the attempt, its wait doubles; there is none after the last."""
    rows = chunks.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(1 + retries))))
    wait = F.when(F.col("attempt") <= retries, BACKOFF * F.pow(F.lit(2), F.col("attempt") - 1)).otherwise(0).cast("long")
    return rows.withColumn("attempt_timeout", F.col("timeout") * F.col("attempt")).withColumn("wait_after", wait)


def is_final(message: Column) -> Column:
    return F.lower(message).rlike(TERMINAL_ERROR)


def retry_outcomes(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """(doc_id, chunk, ok, attempts, message): the first attempt that succeeds or can't be mended, else the last."""
    stop = F.col("ok") | is_final(F.col("message")) | (F.col("attempt") >= 1 + retries)
    return attempts.where(stop).groupBy("doc_id", "chunk").agg(F.min_by(F.struct("ok", "message"), "attempt").alias("e"), F.min("attempt").alias("attempts")).select("doc_id", "chunk", "e.ok", "attempts", "e.message")


def recognition_outcomes(units: DataFrame) -> DataFrame:
    """Per document the sums of its units' outcomes, and a note."""
    sums = units.groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("ocred", "failed", "clean")])
    some = F.concat(F.lit(PARTLY[0]), F.col("failed").cast("string"), F.lit(PARTLY[1]))
    note = F.when((F.col("ocred") > 0) & (F.col("failed") > 0), some).when(F.col("ocred") > 0, REBUILT).when(F.col("failed") > 0, USELESS)
    return sums.withColumn("note", note)


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job, a fold of its events (job_id, seq, kind, message): the last decides, and steps are counted."""
    return events.groupBy("job_id").agg(F.max_by("kind", "seq").alias("status"), F.max_by("message", "seq").alias("message"), F.count_if(F.col("kind") == "step").alias("n_steps"), F.max("seq").alias("last_seq"))


def job_lookup(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """The states of the jobs asked for (job_id), one row each; a job that isn't known has the status 'unknown'."""
    return jobs.select("job_id").join(states, "job_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def admitted_jobs(requests: DataFrame) -> DataFrame:
    """Requests (slot, job_id, start, end) with whether the slot was free: nobody whom the slot already served still ran.

    A request that is refused doesn't hold the slot, so this is a fold over a slot's requests in order; of any number, as only
    the time until which the slot is busy is kept.
    """

    def step(state: list, r) -> tuple:
        free = not state or r.start >= state[0]
        if free:
            state[:] = [r.end]
        return r.slot, r.job_id, free

    return sorted_fold(requests.select("slot", "job_id", "start", "end"), ["slot"], ["start", "job_id"], list, step, "slot int, job_id long, admitted boolean")


def newest(books: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, by name among equals."""
    rows = books.orderBy(F.desc("mtime"), "name")
    return rows.limit(limit) if limit is not None else rows


def list_books(files: DataFrame, sidecars: DataFrame, covers: DataFrame, limit: int | None = None) -> DataFrame:
    """The library's listing: files (name, bytes, mtime) with their sidecars (base, json; malformed counts as none) and covers (name)."""
    f = newest(files, limit).withColumn("base", F.regexp_replace("name", r"\.[^.]*$", ""))
    meta = sidecars.select("base", F.from_json("json", "title string, cover string, ocr_note string").alias("m"))
    joined = f.join(meta, "base", "left").withColumn("cover_file", F.col("m.cover")).join(covers.select(F.col("name").alias("cover_file"), F.col("name").alias("cover")), "cover_file", "left")
    kind = F.regexp_extract(F.lower("name"), r"\.([^.]*)$", 1)
    return joined.select("name", F.coalesce(F.col("m.title"), F.col("base")).alias("title"), kind.alias("format"), human_size(F.col("bytes")).alias("size"), "mtime", "cover", F.col("m.ocr_note").alias("note"))


def sidecar_json(title: Column, file: Column, fmt: Column, cover: Column, pdf: Column, note: Column) -> Column:
    """A book's sidecar; keys without a value are left out."""
    return F.to_json(F.struct(title.alias("title"), file.alias("file"), fmt.alias("format"), cover.alias("cover"), pdf.alias("pdf"), note.alias("ocr_note")), {"ignoreNullFields": "true"})


def unique_names(wanted: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(id, name, unique): in order of id each name as it is if nobody has it, else the first free of 'stem (2).ext', 'stem (3).ext'
    and so on; names in `taken` are had by others from the start.

    Only names with one root can be in each other's way: what is left of the stem without numbers in brackets behind it. Per
    root it's a fold that keeps the names given as they are and, for each name, the next number to try.
    """
    parts = r"^(.*?)((?: \([0-9]+\))*)(\.[^.]*)?$"
    rows = wanted.select("id", "name", F.lit(1).alias("turn"))
    if taken is not None:
        rows = rows.unionByName(taken.select(F.lit(None).cast("long").alias("id"), "name", F.lit(0).alias("turn")).distinct())
    rows = rows.withColumn("root", F.concat(F.regexp_extract("name", parts, 1), F.lit("/"), F.regexp_extract("name", parts, 3)))

    def numbered(name: str) -> tuple[str, int] | None:
        """The name and the number that this name could be given for."""
        stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
        head, _, tail = stem.rpartition(" (")
        n = tail[:-1]
        return (head + dot + ext, int(n)) if tail.endswith(")") and n.isascii() and n.isdigit() and n[0] != "0" and int(n) > 1 else None

    def step(state: dict, r) -> tuple | None:
        def had(name: str) -> bool:
            of = numbered(name)
            return name in state or (of is not None and of[1] < state.get(of[0], 2))

        # state: names that somebody has as they are, with the next number to try for them
        unique = r.name
        if r.turn == 0:
            state.setdefault(r.name, 2)
            return None
        if had(r.name):
            stem, dot, ext = r.name.rpartition(".") if "." in r.name else (r.name, "", "")
            k = state.setdefault(r.name, 2)
            while had(unique := f"{stem} ({k}){dot}{ext}"):
                k += 1
                state[r.name] = k
            state[r.name] = k + 1
        else:
            state[r.name] = 2
        return r.id, r.name, unique

    return sorted_fold(rows, ["root"], ["turn", "id"], dict, step, "id long, name string, unique string")


def deduplicated(contents: DataFrame) -> DataFrame:
    """(doc_id, id, digest, first, number) of a document's images (doc_id, id, xref, content) in order of id: one with a reference is
    the same as others with that reference, one without as others without of the same bytes (by MD5, which names the file);
    first is the first of the same, and these are numbered from 1 in the order first seen."""
    digest = F.md5(F.col("content"))
    key = F.when(F.col("xref").isNotNull(), F.concat(F.lit("xref:"), F.col("xref").cast("string"))).otherwise(digest)
    d = contents.select("doc_id", "id", digest.alias("digest"), key.alias("key"))
    first = d.withColumn("first", F.min("id").over(Window.partitionBy("doc_id", "key")))
    return first.select("doc_id", "id", "digest", "first", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")).alias("number"))


def upload_cut(parts: DataFrame, cap: int) -> DataFrame:
    """(upload, received, cut_part, accepted) of an upload's parts (upload, part, bytes): bytes up to the part that passes the cap, where
    receiving ends, and that part; null and accepted if none does."""
    w = Window.partitionBy("upload").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("running", F.sum("bytes").over(w))
    over = F.col("running") > cap
    sums = rows.groupBy("upload").agg(F.min(F.when(over, F.struct("part", "running"))).alias("cut"), F.max("running").alias("total"))
    return sums.select("upload", F.coalesce("cut.running", "total").cast("long").alias("received"), F.col("cut.part").alias("cut_part"), F.col("cut").isNull().alias("accepted"))


def book_lookup(files: DataFrame, asked: DataFrame, kinds: tuple[str, ...] = BOOKS) -> DataFrame:
    """The files (name, ...) asked for by a bare name (column asked) with an extension of the kinds; others are not found."""
    extension = F.lower(F.regexp_extract("asked", r"(\.[^.]*)$", 1))
    fine = asked.select("asked").distinct().where(is_safe_member(F.col("asked")) & extension.isin(*kinds))
    return files.join(fine, F.col("name") == F.col("asked"), "left_semi")


def without(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """The catalog without some books; sidecars and covers go with their base name."""
    return catalog.join(names.select("base").distinct(), "base", "left_anti")


def config_warnings(settings: DataFrame) -> DataFrame:
    """(rule) of the settings (name, value) that need attention."""
    wide = settings.groupBy().pivot("name", ["secret", "allowed_emails", "client_id", "https", "ocr_mode", "max_mb"]).agg(F.first("value"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = F.array_compact(F.array(
        F.when(blank("secret"), "no session secret"), F.when(blank("allowed_emails"), "nobody is allowed"), F.when(blank("client_id"), "no sign-in client"),
        F.when(F.coalesce("https", F.lit("")) != "true", "cookies without https"), F.when(~F.coalesce("ocr_mode", F.lit("")).isin("auto", "always", "off"), "unknown recognition mode"),
        F.when(F.coalesce(F.col("max_mb").try_cast("int"), F.lit(0)) <= 0, "no upload limit"),
    ))
    return wide.select(F.explode(rules).alias("rule"))
