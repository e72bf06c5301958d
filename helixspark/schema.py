"""Types, alphabets and fixed tables of the sequence domain."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SAMPLE = _struct(sample_id=S, tissue=S, tpm=T.DoubleType())
EXPRESSION = _struct(source=S, accession=S, title=S, organism=S, platform=S, samples=T.ArrayType(SAMPLE), url=S)
PATHWAY = _struct(id=S, name=S, source=S)
PUBLICATION = _struct(
    pmid=S, title=S, abstract=S, authors=T.ArrayType(S), journal=S, year=T.IntegerType(), doi=S, url=S,
    mesh_terms=T.ArrayType(S), keywords=T.ArrayType(S), species=S, source=S)
GENE = _struct(
    gene_id=S, symbol=S, organism=S, sequence=S, sequence_type=S, description=S, source=S, source_url=S,
    external_links=T.MapType(S, S), expression_profiles=T.ArrayType(EXPRESSION), pathways=T.ArrayType(PATHWAY),
    publications=T.ArrayType(PUBLICATION), annotations=S, traits=T.ArrayType(S), length=T.IntegerType(),
    date_added=T.TimestampType(), record=S)
#: One record of a sequence file.
SEQUENCE = _struct(header=S, metadata=T.MapType(S, S), sequence=S)

# Alphabets.
DNA = "ATGCN"
DNA_VALID = "ATGCNRYSWKMBDHV"
AMINO_20 = "ACDEFGHIKLMNPQRSTVWY"
AMINO_VALID = "ACDEFGHIKLMNPQRSTVWYBXZ*"
STOPS = ["TAA", "TAG", "TGA"]

#: The standard genetic code: amino acids of all codons in the order TTT, TTC, TTA, TTG, TCT, ...
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}

# Average masses of the free amino acids in centi-daltons, and of water.
MASS = {
    "A": 8909, "R": 17420, "N": 13212, "D": 13310, "C": 12116, "E": 14713, "Q": 14615, "G": 7507, "H": 15516, "I": 13117, "L": 13117, "K": 14619,
    "M": 14921, "F": 16519, "P": 11513, "S": 10509, "T": 11912, "W": 20423, "Y": 18119, "V": 11715, "B": 13261, "Z": 14664, "X": 11000, "*": 0,
}
WATER = 1802
OTHER_MASS = 11000
# The Kyte-Doolittle scale in tenths.
HYDROPATHY = {
    "A": 18, "R": -45, "N": -35, "D": -35, "C": 25, "Q": -35, "E": -35, "G": -4, "H": -32, "I": 45, "L": 38, "K": -39,
    "M": 19, "F": 28, "P": -16, "S": -8, "T": -7, "W": -9, "Y": -13, "V": 42, "B": -35, "Z": -35, "X": 0, "*": 0,
}
# pKa of the termini and of the charged side chains.
PKA_POSITIVE = {"N_TERM": 9.69, "K": 10.54, "R": 12.48, "H": 6.04}
PKA_NEGATIVE = {"C_TERM": 2.34, "D": 3.86, "E": 4.25, "C": 8.33, "Y": 10.07}
# Property groups of the amino acids.
GROUPS = {"nonpolar": "AVLIMFWPG", "polar": "STCYNQ", "acidic": "DE", "basic": "KRH"}
# Regulatory motifs; N stands for any base.
MOTIFS = {
    "TATA-box": "TATAAA", "CAAT-box": "CCAAT", "GC-box": "GGGCGG", "E-box": "CANNTG", "W-box": "TTGACT",
    "ABRE (ABA response)": "ACGTGG", "MYC recognition": "CANNTG", "DRE/CRT element": "TACCGACAT",
}
# Spellings of the sequence types.
TYPE_SYNONYMS = {"mrna": "rna", "trna": "rna", "rrna": "rna", "transcript": "rna", "genomic": "dna", "aa": "protein"}
# Least scores, in percent, of the similarity classes, and bounds of GC content.
SIMILARITY = {"very_high": 90.0, "high": 75.0, "moderate": 55.0, "low": 35.0}
GC_HIGH, GC_LOW = 60.0, 35.0
# BLOSUM62, lower triangle in the usual order of residues.
BLOSUM_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM_ROWS = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""

#: Words by which records declare what kind of sequence they hold.
DECLARED = {
    "protein": ["protein", "aa", "amino_acid", "peptide"],
    "rna": ["rna", "mrna", "trna", "rrna", "transcript"],
    "dna": ["dna", "genomic", "cdna", "cds", "nucleotide"],
}

#: Longest sequence of each type that is collected.
CAPS = {"dna": 100_000, "rna": 50_000, "protein": 20_000}
