"""Module trees, clusters of items, and source text by line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rust_lines
from ..session import cut, spread

#: Traits whose implementations say nothing.
TRIVIAL = ("Debug", "Clone", "Copy", "Default", "Display", "PartialEq", "Eq", "Hash", "PartialOrd", "Ord")
HEADER = r"^(pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod|type|static|const|union)\b\s*(?:<[^>]*>\s*)?([A-Za-z_][A-Za-z0-9_:]*)?"


def module_of(path: Column) -> Column:
    """a/b/mod.rs -> a::b, below src if there is one; lib.rs and main.rs give crate."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^.*/src/", ""), r"\.rs$", "")
    kept = F.filter(F.split(inner, "/"), lambda p: ~p.isin("", "mod", "lib", "main"))
    return F.when(F.size(kept) == 0, "crate").otherwise(F.array_join(kept, "::"))


def semantic_module(path: Column) -> Column:
    """The plain substring rule of search results: a trailing .rs goes, / becomes ::, then ::mod, ::lib and ::main."""
    p = F.replace(F.regexp_replace(path, r"(\.rs)+$", ""), F.lit("/"), F.lit("::"))
    return F.replace(F.replace(F.replace(p, F.lit("::mod"), F.lit("")), F.lit("::lib"), F.lit("crate")), F.lit("::main"), F.lit("crate"))


def modules(chunks: DataFrame) -> DataFrame:
    return chunks.where("crate_name IS NOT NULL AND module_path IS NOT NULL").select("crate_name", F.col("module_path").alias("module")).distinct()


def declared(chunks: DataFrame) -> DataFrame:
    """(crate_name, parent, sub): the submodules that a module's source declares, once each."""
    named = declarations(chunks.where("module_path IS NOT NULL AND crate_name IS NOT NULL")).join(chunks.select("crate_name", "chunk_id", F.col("module_path").alias("parent")), ["crate_name", "chunk_id"])
    return named.select("crate_name", "parent", F.col("declared").alias("sub")).distinct()


def children(chunks: DataFrame, by_path: bool = False) -> DataFrame:
    """(crate_name, parent, module): declared submodules that exist; those of the crate's root by their own name, others by parent::sub.

    With ``by_path`` a module also hangs on the one that its path names, if that is there: a
    source that holds only part of a file's items may lack the declaration.
    """
    full = F.when(F.col("parent") == "crate", F.col("sub")).otherwise(F.concat("parent", F.lit("::"), "sub"))
    mods = modules(chunks)
    links = declared(chunks).select("crate_name", "parent", full.alias("module")).join(mods, ["crate_name", "module"]).select("crate_name", "parent", "module")
    if by_path:
        m = F.col("module")
        above = mods.where(m != "crate").select("crate_name", F.when(m.contains("::"), F.regexp_replace(m, r"::[^:]*$", "")).otherwise("crate").alias("parent"), "module")
        links = links.unionByName(above.join(mods.select("crate_name", m.alias("parent")), ["crate_name", "parent"]).select("crate_name", "parent", "module"))
    return links.distinct()


def workspace(chunks: DataFrame, by_path: bool = False) -> DataFrame:
    """(parent, module): the links of all crates in one graph, names led by the crate's, below a made root ``workspace``.

    Crates that have a module ``crate`` hang on the root by their name.
    """
    lead = lambda m: F.when(m == "crate", F.col("crate_name")).otherwise(F.concat("crate_name", F.lit("::"), m))
    roots = modules(chunks).where("module = 'crate'").select(F.lit("workspace").alias("parent"), F.col("crate_name").alias("module"))
    return children(chunks, by_path).select(lead(F.col("parent")).alias("parent"), lead(F.col("module")).alias("module")).unionByName(roots)


def reached(links: DataFrame, root: str = "workspace", depth: int = 64) -> DataFrame:
    """(module, depth): breadth first from the root over (parent, module) links, down to ``depth``; every module once, at its least depth.

    Each level is written to the shared folder; the walk ends with the first empty one, so links that lead round end too.
    """
    links = cut(links.where("parent IS NOT NULL AND module IS NOT NULL").distinct())
    front = links.sparkSession.createDataFrame([(root, 0)], "module string, depth int")
    seen = front
    for d in range(1, depth + 1):
        nxt = front.select(F.col("module").alias("parent")).join(links, "parent").select("module").distinct()
        front = cut(nxt.join(seen, "module", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def declarations(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, declared): the names that ``mod`` lines declare, tests aside."""
    line = chunks.where("raw_source IS NOT NULL").select("crate_name", "chunk_id", F.explode(rust_lines(F.col("raw_source"))).alias("line"))
    named = F.regexp_extract("line", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([^\s;{]+)", 1)
    return line.select("crate_name", "chunk_id", named.alias("declared")).where("declared NOT IN ('', 'tests')")


def headers(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, line_no, kind, name, visibility, trivial): item headers at the line's start, line by line.

    A quick survey of what a chunk declares, within Spark's regular expressions; it does not know
    strings or comments. ``trivial`` marks implementations of the ten traits that say nothing.
    """
    at = chunks.where("raw_source IS NOT NULL").select("crate_name", "chunk_id", F.posexplode(rust_lines(F.col("raw_source"))).alias("pos", "line"))
    at = at.where(F.col("line").rlike(HEADER))
    vis = F.regexp_extract("line", HEADER, 1)
    name = F.regexp_extract("line", HEADER, 3)
    visibility = F.when(vis == "", "private").when(vis.rlike(r"^pub\s+$"), "public").when(vis.contains("(crate)"), "crate").otherwise("restricted")
    trait = F.substring_index(name, "::", -1)
    trivial = (F.regexp_extract("line", HEADER, 2) == "impl") & trait.isin(*TRIVIAL) & F.col("line").rlike(r"\sfor\s")
    return at.select("crate_name", "chunk_id", (F.col("pos") + 1).alias("line_no"), F.regexp_extract("line", HEADER, 2).alias("kind"), name.alias("name"), visibility.alias("visibility"), trivial.alias("trivial"))


_HEAD = re.compile(HEADER)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each header the first later line at which its braces balance: one walk over a source's lines with a stack."""
    for b in batches:
        at, start, end = [], [], []
        for i, source in enumerate(b["raw_source"]):
            lines = source.replace("\r\n", "\n").removesuffix("\n").split("\n")
            depth, open_, found = 0, [], {}
            for n, line in enumerate(lines, 1):
                base = depth
                depth += line.count("{") - line.count("}")
                while open_ and open_[-1][1] >= depth:
                    found[open_.pop()[0]] = n
                if _HEAD.match(line):
                    found[n] = len(lines)
                    held = []
                    while open_ and open_[-1][1] > base:  # bases rise from the bottom of the stack
                        held.append(open_.pop())
                    open_ += [(n, base), *held[::-1]]
            at += [i] * len(found)
            start += sorted(found)
            end += [found[n] for n in sorted(found)]
        keys = b[["crate_name", "chunk_id"]].iloc[at].reset_index(drop=True)
        yield keys.assign(line_no=pd.array(start, "int32"), end_line=pd.array(end, "int32"))


def spans(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, line_no, end_line): from each header's line to the first later one at which its braces balance.

    Braces in strings and comments count. A header whose braces never balance ends with the chunk.
    Rows are independent, so nothing is shuffled; the walk is linear in the text.
    """
    return spread(chunks.where("raw_source IS NOT NULL").select("crate_name", "chunk_id", "raw_source"), "crate_name", "chunk_id").mapInPandas(_ends, "crate_name string, chunk_id string, line_no int, end_line int")


METHOD = r"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|const\s+)*fn\s+([A-Za-z_][A-Za-z0-9_]*)"
FIELD = r"^\s+(?:pub(?:\([^)]*\))?\s+)?([a-z_][A-Za-z0-9_]*):\s*([^,]*),?\s*$"
VARIANT = r"^\s+([A-Z][A-Za-z0-9_]*)"
TARGET = r"^impl\b\s*(?:<[^>]*>\s*)?(?:([^{]*?)\s+for\s+)?([^{]*)"


def items(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, place, line_no, kind, name, trait, target, signature, methods, owned, unsafe, phantom, chars): the top-level items of each chunk, in order.

    A header at a line's start begins an item, and the lines up to the next header are its own;
    ``///`` lines at a line's start belong to the item after them. ``owned``: a method takes self by
    value; ``unsafe``: it or one of its methods is; ``chars`` is what the estimate of tokens
    counts: 20 an item and a method, the names, field types and four, variants and ten, signatures,
    the lines of functions and methods, and doc lines of structs, enums and functions. Only
    headers and numbers are shuffled, by chunk. Impls of traits that say nothing are left out.
    """
    at = chunks.where("raw_source IS NOT NULL").select("crate_name", "chunk_id", F.posexplode(rust_lines(F.col("raw_source"))).alias("pos", "line"))
    x = lambda rx, i: F.regexp_extract("line", rx, i)
    size = lambda c: F.octet_length(c)
    head, doc, method = F.col("line").rlike(HEADER), F.col("line").startswith("///"), F.col("line").rlike(METHOD)
    marked = at.select(
        "crate_name", "chunk_id", (F.col("pos") + 1).alias("line_no"), head.alias("head"), doc.alias("doc"), F.when(head, F.col("line")).alias("text"), method.cast("int").alias("method"),
        (method & F.col("line").rlike(r"\((?:mut )?self\b")).alias("owned"), F.col("line").rlike(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|const\s+)*unsafe\s+(?:extern\s+\S+\s+)?fn\b").alias("unsafe"), F.col("line").contains("PhantomData").alias("phantom"),
        F.when(F.col("line").rlike(FIELD), size(x(FIELD, 1)) + size(F.trim(x(FIELD, 2))) + 4).otherwise(0).alias("field"), F.when(F.col("line").rlike(VARIANT), size(x(VARIANT, 1)) + 10).otherwise(0).alias("variant"),
        F.when(method, size(x(METHOD, 1)) + 10).otherwise(0).alias("named"), F.when(doc, size(F.trim(F.substring("line", 4, 1 << 30)))).otherwise(0).alias("doc_size"), F.when(~head & ~doc, size(F.trim("line"))).otherwise(0).alias("line_size"),
    )
    w = Window.partitionBy("crate_name", "chunk_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.sum(F.col("head").cast("int")).over(w) + F.col("doc").cast("int")
    total = lambda c: F.sum(c).alias(c)
    per = marked.withColumn("place", owner).where("place > 0").groupBy("crate_name", "chunk_id", "place").agg(
        F.min(F.when(F.col("head"), F.col("line_no"))).alias("line_no"), F.max("text").alias("line"), F.sum("method").cast("int").alias("methods"), F.bool_or("owned").alias("owned"), F.bool_or("unsafe").alias("unsafe"), F.bool_or("phantom").alias("phantom"),
        *map(total, ("field", "variant", "named", "doc_size", "line_size")),
    ).where("line IS NOT NULL")
    kind, is_impl = x(HEADER, 2), x(HEADER, 2) == "impl"
    trait = F.when(is_impl & (x(TARGET, 1) != ""), F.trim(x(TARGET, 1)))
    target, signature = F.when(is_impl, F.trim(x(TARGET, 2))), F.trim(F.regexp_extract("line", r"^[^{;]*", 0))
    body = F.col("line_size")
    chars = (
        F.when(kind == "struct", size(x(HEADER, 3)) + F.col("field") + 20 + F.col("doc_size"))
        .when(kind == "enum", size(x(HEADER, 3)) + F.col("variant") + 20 + F.col("doc_size"))
        .when(kind == "fn", size(signature) + 20 + F.col("doc_size") + body)
        .when(kind == "trait", size(x(HEADER, 3)) + F.col("named") + 20)
        .when(is_impl, size(target) + 20 + 20 * F.col("methods") + body)
        .otherwise(0)
    )
    out = per.select("crate_name", "chunk_id", "place", "line_no", kind.alias("kind"), x(HEADER, 3).alias("name"), trait.alias("trait"), target.alias("target"), signature.alias("signature"), "methods", "owned", "unsafe", "phantom", chars.cast("bigint").alias("chars"))
    return out.where(F.col("kind").isin("struct", "enum", "fn", "trait", "impl") & ~F.coalesce(F.substring_index(F.trim(F.substring_index("trait", "<", 1)), "::", -1).isin(*TRIVIAL), F.lit(False)))


def clusters(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, cluster, anchor, types, traits, functions, impls, summary, tokens, lines): a chunk's items by the type they speak of.

    Every struct, then every enum, in order, is an anchor. An impl goes to the first anchor whose
    name is part of the type it is for, a function to the first whose name is part of its
    signature; traits and what no anchor claims make up the last, loose cluster. A loose cluster
    of impls without methods only is dropped. tokens are a quarter of the items' chars; lines are
    the first lines of its types and impls. One chunk's items meet in one task.
    """
    it = items(chunks)
    per = it.groupBy("crate_name", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "line_no", "kind", "name", "trait", "target", "signature", "methods", "chars"))).alias("items"))
    of = lambda *kinds: F.filter("items", lambda y: y["kind"].isin(*kinds))
    per = per.withColumn("anchors", F.concat(of("struct"), of("enum")))
    text = F.when(F.col("i.kind") == "impl", F.col("i.target")).when(F.col("i.kind") == "fn", F.col("i.signature"))
    own = F.array_position(F.transform("anchors", lambda y: y["place"]), F.col("i.place"))
    claims = F.array_position(F.transform("anchors", lambda y: text.contains(y["name"])), F.lit(True))
    claimed = F.when(F.col("i.kind").isin("struct", "enum"), own).when(F.col("i.kind") == "trait", 0).otherwise(claims)
    rows = per.select("crate_name", "chunk_id", "anchors", F.explode("items").alias("i")).select("crate_name", "chunk_id", F.size("anchors").alias("n"), "i", claimed.alias("c"), F.get("anchors", (claimed - 1).cast("int"))["name"].alias("anchor"))
    rows = rows.select("crate_name", "chunk_id", F.when(F.col("c") > 0, F.col("c") - 1).otherwise(F.col("n")).cast("int").alias("cluster"), "anchor", "i")
    k = F.col("i.kind")
    impl = F.concat(F.lit("impl "), F.when(F.col("i.trait").isNotNull(), F.concat("i.trait", F.lit(" for "))).otherwise(""), F.col("i.target"), F.lit(" ("), F.col("i.methods"), F.lit(" methods)"))
    word = F.when(k.isin("struct", "enum", "trait"), F.concat(k, F.lit(" "), F.col("i.name"))).when(k == "impl", impl)
    rank = F.when(k.isin("struct", "enum"), 0).when(k == "trait", 1).otherwise(3)
    grouped = rows.groupBy("crate_name", "chunk_id", "cluster").agg(
        F.max("anchor").alias("anchor"), *[F.count_if(c).alias(n) for c, n in ((k.isin("struct", "enum"), "types"), (k == "trait", "traits"), (k == "fn", "functions"), (k == "impl", "impls"))],
        F.array_sort(F.collect_list(F.when(word.isNotNull(), F.struct(rank.alias("rank"), F.col("i.place"), word.alias("word"))))).alias("words"), F.sum("i.chars").alias("chars"), F.sum("i.methods").alias("methods"),
        F.array_sort(F.collect_list(F.when(k != "fn", F.col("i.line_no")))).alias("lines"),
    )
    free = F.when(F.col("functions") > 0, F.array(F.concat(F.col("functions").cast("string"), F.lit(" free function(s)")))).otherwise(F.array().cast("array<string>"))
    said = lambda low: F.transform(F.filter("words", lambda y: (y["rank"] < 2) == low), lambda y: y["word"])
    kept = grouped.where("types + traits + functions > 0 OR methods > 0")
    return kept.select("crate_name", "chunk_id", "cluster", "anchor", "types", "traits", "functions", "impls", F.array_join(F.concat(said(F.lit(True)), free, said(F.lit(False))), ", ").alias("summary"), (F.col("chars") / 4).cast("bigint").alias("tokens"), "lines")


def siblings(parts: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, cluster, part, siblings): a cluster's name, numbered where a chunk has several, and the other clusters' summaries in order.

    A chunk's clusters meet in one task.
    """
    w = Window.partitionBy("crate_name", "chunk_id").orderBy("cluster")
    every = F.transform(F.array_sort(F.collect_list(F.struct("cluster", "summary")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), lambda x: x["summary"])
    placed = parts.withColumn("every", every).withColumn("place", F.row_number().over(w))
    others = F.filter("every", lambda x, i: i != F.col("place") - 1)
    several = F.size("every") > 1
    return placed.select("crate_name", "chunk_id", "cluster", F.when(several, F.concat("chunk_id", F.lit("#"), F.col("place") - 1)).otherwise(F.col("chunk_id")).alias("part"), F.when(several, F.array_join(others, "; ")).alias("siblings"))


GAP = "\n// ... (other code) ...\n\n"


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [extract(s, list(n), [a] if a else []) for s, n, a in zip(b["raw_source"], b["lines"], b["anchor"])]
        yield b[["crate_name", "chunk_id", "cluster"]].assign(source=out)


def extract(source: str, starts: list[int], names: list[str]) -> str:
    """The lines of a source that belong to a cluster: from three before each start to the first later line at which its braces balance.

    Starts on the first line do not count; without starts it is five lines around each mention of
    a name; without names the whole source. Left-out stretches are marked.
    """
    if not names:
        return source
    lines = source.replace("\r\n", "\n").removesuffix("\n").split("\n")
    keep = [False] * len(lines)
    starts = [n for n in starts if 1 < n <= len(lines)]
    for n in starts:
        depth, end = 0, n - 1
        for i in range(n - 1, len(lines)):
            depth, end = depth + lines[i].count("{") - lines[i].count("}"), i
            if depth <= 0 and i > n - 1:
                break
        keep[max(0, n - 4) : end + 1] = [True] * (end + 1 - max(0, n - 4))
    if not starts:
        for i, line in enumerate(lines):
            if any(x in line for x in names):
                keep[max(0, i - 5) : i + 6] = [True] * (min(len(lines), i + 6) - max(0, i - 5))
    out, before = [], False
    for line, k in zip(lines, keep):
        if k:
            out += [GAP if out and not before else "", line, "\n"]
        before = k
    return "".join(out)


def cluster_sources(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, cluster, source): each cluster with the lines of its chunk that belong to it."""
    c = clusters(chunks).select("crate_name", "chunk_id", "cluster", "anchor", "lines")
    return c.join(chunks.select("crate_name", "chunk_id", "raw_source"), ["crate_name", "chunk_id"]).select("crate_name", "chunk_id", "cluster", "anchor", "lines", "raw_source").mapInPandas(_extracted, "crate_name string, chunk_id string, cluster int, source string")


def claims(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, impl_block, anchor): each implementation goes to the first type of its chunk, structs before enums, whose name is part of its text."""
    anchors = F.concat(F.coalesce("structs", F.array()), F.coalesce("enums", F.array()))
    one = chunks.select("crate_name", "chunk_id", anchors.alias("anchors"), F.explode("impl_blocks").alias("impl_block"))
    return one.select("crate_name", "chunk_id", "impl_block", F.get(F.filter("anchors", lambda a: F.col("impl_block").contains(a)), F.lit(0)).alias("anchor"))


def summary(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, summary, has_content): what a cluster holds, in words."""
    each = lambda c, word: F.transform(F.coalesce(c, F.array()), lambda x: F.concat(F.lit(word + " "), x))
    fns = F.size(F.coalesce("functions", F.array()))
    free = F.when(fns > 0, F.array(F.concat(fns.cast("string"), F.lit(" free function(s)")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(each(F.col("structs"), "struct"), each(F.col("enums"), "enum"), each(F.col("traits"), "trait"), free, each(F.col("impl_blocks"), "impl"))
    return chunks.select("crate_name", "chunk_id", F.array_join(parts, ", ").alias("summary"), (F.size(parts) > 0).alias("has_content"))


def ordinals(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, ordinal, parts, siblings): a chunk's place among its module's, and the others' ids in order.

    A module's chunks come from one file, so its group is as small as a file.
    """
    w = Window.partitionBy("crate_name", "module_path").orderBy("chunk_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chunks.where("module_path IS NOT NULL").withColumn("all", F.collect_list("chunk_id").over(whole))
    others = F.filter("all", lambda x: x != F.col("chunk_id"))
    return rows.select("crate_name", "chunk_id", (F.row_number().over(w) - 1).alias("ordinal"), F.size("all").alias("parts"), F.array_join(others, "; ").alias("siblings"))


def tokens_of(chunks: DataFrame) -> DataFrame:
    """(crate_name, chunk_id, tokens): a quarter of what its items' names, fields, signatures and bodies hold; 0 without items."""
    held = items(chunks).groupBy("crate_name", "chunk_id").agg(F.sum("chars").alias("chars"))
    return chunks.select("crate_name", "chunk_id").join(held, ["crate_name", "chunk_id"], "left").select("crate_name", "chunk_id", (F.coalesce("chars", F.lit(0)) / 4).cast("bigint").alias("tokens"))


def scores(chunks: DataFrame, prefixes: list[str]) -> DataFrame:
    """(crate_name, chunk_id, score): what is to be looked at first.

    1000 once if the module path contains a prefix; 50 for each struct with a phantom marker, 40
    for each impl of Drop, 30 for each impl with a method that takes self by value, 20 for each
    with an unsafe method, 20 once for unsafe functions, 10 once for a telling word.
    """
    k, n = F.col("kind"), lambda c, v: F.count_if(c) * v
    found = items(chunks).groupBy("crate_name", "chunk_id").agg(
        (n((k == "struct") & F.col("phantom"), 50) + n((k == "impl") & (F.col("trait") == "Drop"), 40) + n((k == "impl") & F.col("owned"), 30) + n((k == "impl") & F.col("unsafe"), 20) + F.when(F.count_if((k == "fn") & F.col("unsafe")) > 0, 20).otherwise(0)).alias("found")
    )
    hit = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.coalesce(F.col("module_path"), F.lit("")).contains(p)) if prefixes else F.lit(False)
    telling = F.lower(F.coalesce("raw_source", F.lit(""))).rlike("safety|must|invariant|precondition")
    base = chunks.select("crate_name", "chunk_id", (hit.cast("int") * 1000 + telling.cast("int") * 10).alias("base"))
    return base.join(found, ["crate_name", "chunk_id"], "left").select("crate_name", "chunk_id", (F.col("base") + F.coalesce("found", F.lit(0))).cast("bigint").alias("score"))
