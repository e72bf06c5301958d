"""Nucleotide functions as column expressions: no function leaves the JVM.

Every function takes and returns a ``Column``.  Null gives null; positions
are 1-based unless said otherwise; an empty text gives 0, an empty text or an
empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixspark import schema


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def count_of(s: Column, letters: str) -> Column:
    """How many of ``letters`` occur in ``s``."""
    return (F.length(s) - F.length(F.translate(s, letters, ""))).cast("bigint")


def starts_of(s: Column, width: int, step: int = 1, first: int = 1) -> Column:
    """Start positions of all windows of ``width``; empty where none fits."""
    last = F.length(s) - (width - 1)
    return F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def bare(s: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(s, r"\s+", ""))


def clean_dna(s: Column) -> Column:
    """Lines that start with ``>`` dropped, the rest joined in upper case, letters that are no base code dropped."""
    return F.regexp_replace(F.upper(F.regexp_replace(s, r"(?m)^>.*$", "")), f"[^{schema.DNA_VALID}]", "")


def clean_protein(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(s, r"(?m)^>.*$", "")), r"[^ACDEFGHIKLMNPQRSTVWYBXZ*]", "")


def detect_type(s: Column) -> Column:
    """``dna``, ``protein`` or ``unknown`` by alphabet; letters outside both count as DNA unless they are amino-acid codes."""
    c = F.upper(F.regexp_replace(s, r"[^A-Za-z*]", ""))
    return (
        F.when(c == "", "unknown")
        .when(c.rlike(r"^[ATGCN]+$"), "dna")
        .when(c.rlike(r"^[ACDEFGHIKLMNPQRSTVWYBXZ*]+$"), "protein")
        .when(c.rlike(r"[BJOUXZ*]"), "protein")
        .otherwise(F.when(c.isNotNull(), "dna"))
    )


def detect_type_strict(s: Column) -> Column:
    """As ``detect_type``, but ambiguity codes stay DNA and U makes RNA."""
    c = F.upper(F.regexp_replace(s, r"[^A-Za-z*]", ""))
    return (
        F.when(c == "", "unknown").when(c.rlike(rf"^[{schema.DNA_VALID}]+$"), "dna").when(c.rlike(r"^[ACGUN]+$"), "rna")
        .when(c.rlike(r"^[ACDEFGHIKLMNPQRSTVWYBXZ*]+$"), "protein").otherwise(F.when(c.isNotNull(), "unknown"))
    )


def normal_type(declared: Column, s: Column) -> Column:
    """Declared type in one spelling; where it says nothing, the type its letters suggest."""
    d = F.lower(F.trim(declared))
    d = F.coalesce(F.element_at(_map(schema.TYPE_SYNONYMS), d), d)
    letters = F.upper(F.regexp_replace(s, r"\s+", ""))
    guess = F.when(letters.rlike(r"^[ACGTUN]+$"), F.when(letters.contains("U"), "rna").otherwise("dna")).otherwise("protein")
    return F.when(F.coalesce(d, F.lit("")) == "", guess).when(d.isin("dna", "rna", "protein"), d).otherwise("dna")


def validate(s: Column, kind: Column, least_dna: int = 10, least_protein: int = 5) -> Column:
    """First fault of a sequence as text; ``ok`` if there is none."""
    protein = kind == "protein"
    wrong = lambda valid: F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(s, f"[{valid}]", ""), ""))), ", ")
    bad = F.when(protein, wrong("ACDEFGHIKLMNPQRSTVWYBXZ*")).otherwise(wrong(schema.DNA_VALID))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "empty")
        .when(protein & (F.length(s) < least_protein) | ~protein & (F.length(s) < least_dna), "too short")
        .when(bad != "", F.concat(F.lit("invalid characters: "), bad))
        .otherwise("ok")
    )


def record_class(sequence: Column, declared: Column, source: Column, accession: Column | None = None) -> Column:
    """FLT-04: ``dna``, ``rna``, ``protein`` or ``unknown`` of a record with letters, by its declared type, else its alphabet; else the kind of its metadata."""
    s, kind = F.upper(F.trim(F.coalesce(sequence, F.lit("")))), F.lower(F.coalesce(declared, F.lit("")))
    by_type = F.element_at(_map({w: t for t, ws in schema.DECLARED.items() for w in ws}), kind)
    by_letters = F.when(s.rlike("[BFJLOUZX]"), "protein").when(s.rlike("^[ACGTUN]+$"), "dna").when(s.rlike("^[ACGTURYSWKMBDHVN]+$"), "rna").otherwise("unknown")
    origin = F.lower(F.coalesce(source, F.lit("")))
    series = F.coalesce(accession.startswith("GSE"), F.lit(False)) if accession is not None else F.lit(False)
    metadata = F.when(origin.contains("geo") | series, "metadata_geo").when(origin.contains("atlas"), "metadata_atlas").otherwise("metadata")
    return F.when(s != "", F.coalesce(by_type, by_letters)).otherwise(metadata)


def gc_fraction(s: Column) -> Column:
    """(G + C) / length, ambiguous letters in the denominator; 0 for an empty text."""
    return F.when(F.length(s) == 0, 0.0).otherwise(count_of(s, "GC") / F.length(s))


def complement(s: Column) -> Column:
    return F.translate(s, "ATGCN", "TACGN")


def reverse_complement(s: Column) -> Column:
    """Ambiguity codes other than N stay as they are."""
    return F.reverse(complement(s))


def as_dna(s: Column) -> Column:
    return F.translate(s, "Uu", "Tt")


def gc3(s: Column) -> Column:
    """G + C share of the third codon positions of frame 0; null without codons."""
    thirds = F.regexp_replace(s, r"(?s)..(.)|..?$", "$1")
    return F.when(F.length(s) >= 3, count_of(thirds, "GC") / F.floor(F.length(s) / 3))


def words(s: Column, k: int, frame: int = 0) -> Column:
    """Words of ``k`` letters laid end to end from ``frame`` on, a shorter rest left out; linear in the length."""
    return F.regexp_extract_all(F.substr(s, F.lit(frame + 1)), F.lit(f"(?s)(.{{{k}}})"), F.lit(1))


def codons(s: Column, frame: int = 0) -> Column:
    return words(s, 3, frame)


def amino_acids(s: Column, frame: int = 0) -> Column:
    """Translation of all codons of a frame, stops as ``*``, unknown codons as ``?``.

    A codon's place in one constant text gives its amino acid's place in
    another: no map is built or searched per codon.
    """
    listed, code = F.lit("".join(f",{c}" for c in schema.CODONS)), F.lit("".join(schema.CODONS.values()))

    def amino(c: Column) -> Column:
        at = F.position(c, listed)
        return F.when(at > 0, F.substring(code, (at + 2) / 4, F.lit(1))).otherwise("?")

    return F.array_join(F.transform(codons(s, frame), amino), "")


def up_to_stop(whole: Column) -> Column:
    """``struct(protein, stop_position, status)`` of a translation: up to the first stop, which is left out; stops count codons from 0."""
    stop = F.locate("*", whole)
    return F.struct(
        F.substring_index(whole, "*", 1).alias("protein"),
        F.when(stop > 0, stop - 1).cast("bigint").alias("stop_position"),
        F.when(stop > 0, "complete").otherwise("no_stop_codon").alias("status"))


def six_frames(s: Column) -> Column:
    """Array of ``struct(frame, bases)``: what each of the three frames of both strands reads."""
    strands = (("+", s), ("-", reverse_complement(s)))
    return F.array(*[F.struct(F.lit(f"{sign}{f + 1}").alias("frame"), F.substr(x, F.lit(f + 1)).alias("bases")) for sign, x in strands for f in range(3)])


def has_start(s: Column) -> Column:
    """A start codon in any of six frames, that is anywhere on either strand."""
    return s.contains("ATG") | s.contains("CAT")


def has_stop(s: Column) -> Column:
    return s.rlike("TAA|TAG|TGA|TTA|CTA|TCA")


def melting_temperature(s: Column) -> Column:
    """Wallace rule up to 13 bases, the GC formula beyond; null for an empty text."""
    n, gc = F.length(s), count_of(s, "GC")
    return F.when(n == 0, F.lit(None).cast("double")).when(n <= 13, (2 * count_of(s, "AT") + 4 * gc).cast("double")).otherwise(64.9 + 41 * (gc - 16.4) / n)


def sha_prefix(s: Column) -> Column:
    return F.substring(F.sha2(F.upper(s), 256), 1, 16)


def taxonomy(organism: Column) -> Column:
    """``struct(genus, species)``: the first two words."""
    words = F.split(F.trim(organism), r"\s+")
    return F.struct(F.get(words, F.lit(0)).alias("genus"), F.get(words, F.lit(1)).alias("species"))


def kmers(s: Column, k: int) -> Column:
    """Distinct words of ``k`` letters: those of each of the ``k`` offsets laid end to end."""
    return F.array_distinct(F.flatten(F.array(*[words(s, k, o) for o in range(k)])))


def kmer_code(word: Column, alphabet: str) -> Column:
    """Positional code of a word in the base of its alphabet, of at most 36 letters; null if it holds another letter or none."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[: len(alphabet)]
    valid = (F.length(word) > 0) & (F.translate(word, alphabet, "") == "")
    return F.when(valid, F.conv(F.translate(word, alphabet, digits), len(alphabet), 10).cast("bigint"))


def kmer_word(code: Column, alphabet: str, k: int) -> Column:
    """The word of ``k`` letters that has this code; null for codes that no word has."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[: len(alphabet)]
    number = F.lower(F.conv(code.cast("string"), 10, len(alphabet)))
    return F.when((code >= 0) & (code < len(alphabet) ** k), F.translate(F.lpad(number, k, "0"), digits, alphabet))


def signature(s: Column, k: int = 5) -> Column:
    """Sorted distinct words of ``k`` letters."""
    return F.array_sort(kmers(s, k))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the padded lower-case words of a text: two blanks before, one after each word."""
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def runs(s: Column, least: int = 6) -> Column:
    """Homopolymer runs of at least ``least`` letters, as texts in order."""
    return F.regexp_extract_all(s, F.lit(rf"((.)\2{{{least - 1},}})"), F.lit(1))


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^_[a-z]{2,20}[_-]", "")


def gc_category(percent: Column) -> Column:
    return F.when(percent >= schema.GC_HIGH, "GC-rich").when(percent <= schema.GC_LOW, "AT-rich").when(percent.isNotNull(), "balanced")


def length_class(n: Column) -> Column:
    return F.when(n < 100, "short_fragment").when(n < 500, "medium_fragment").when(n < 2000, "gene_length").when(n.isNotNull(), "large_sequence")


def similarity_class(percent: Column) -> Column:
    out = None
    for name, least in schema.SIMILARITY.items():
        out = F.when(percent >= least, name) if out is None else out.when(percent >= least, name)
    return out.when(percent.isNotNull(), "very_low")


def confidence_label(percent: Column) -> Column:
    return F.when(percent >= schema.SIMILARITY["high"], "High").when(percent >= schema.SIMILARITY["moderate"], "Medium").when(percent.isNotNull(), "Low")
