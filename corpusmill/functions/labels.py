"""Predicates on tags, phrase labels and dependency relations (F9), as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Penn Treebank tags and labels, Universal and Clear dependency relations.
VERB_TAGS = ("MD", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
ADVERB_TAGS = ("RB", "RBR", "RBS")
NOUN_TAGS = ("NN", "NNS", "NNP", "NNPS")
CLAUSES = ("S", "SBAR", "SBARQ", "SINV", "SQ")
PHRASES = ("ADJP", "ADVP", "CONJP", "FRAG", "INTJ", "LST", "NAC", "NP", "NX", "PP", "PRN", "PRT", "QP", "RRC", "UCP", "VP", "WHADJP", "WHADVP", "WHNP", "WHPP", "X")
SUBJECTS = ("nsubj", "nsubj:pass", "csubj")
RELATIVE = ("acl:relcl", "relcl")
WH_RELATIONS = ("nsubj", "nmod:poss", "poss", "obl", "obj", "dobj", "pobj")


def clause_level(label: Column) -> Column:
    return label.isin(*CLAUSES)


def phrase_level(label: Column) -> Column:
    return label.isin(*PHRASES)


def wh_word(tag: Column, dep: Column) -> Column:
    """A question or relative word in a place where it stands for another."""
    return tag.isin("WDT", "WP", "WP$") & dep.isin(*WH_RELATIONS) | (tag == "WRB") & (dep == "advmod")


def adjective_like(label: Column, dep: Column) -> Column:
    return label.isin("ADJP", "JJ", "JJR", "JJS") | (dep == "amod")


def noun_like(label: Column, dep: Column) -> Column:
    return label.isin("WHNP", "WP", "NP", *NOUN_TAGS, "PRP") | dep.isin("nsubj", "nsubj:pass")


def verb_like(label: Column, dep: Column) -> Column:
    return label.isin("VP", *VERB_TAGS[1:]) & F.coalesce(dep != "amod", F.lit(True))


def simple_verb(tag: Column) -> Column:
    return tag.isin(*VERB_TAGS)


def word_category(tag: Column) -> Column:
    """NOUN, ADJ, VERB or OTHER of a tag."""
    return F.when(tag.isin("WP", *NOUN_TAGS, "PRP"), "NOUN").when(tag.isin("JJ", "JJR", "JJS"), "ADJ").when(simple_verb(tag), "VERB").otherwise("OTHER")
