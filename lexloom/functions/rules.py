"""Parameters and rule tables that results depend on."""

from __future__ import annotations

# fixed values: context weights of the meaning picker
PRIOR, DIST_DECAY, POS_BONUS, POS_OTHER = 2.0, 0.04, 4.0, 0.5
INDIRECT, INDIRECT_MAX, SIG_REF = 0.35, 2.0, 150
MIN_CLUE, CLUE_SHARE, CUE_CAP = 0.8, 0.12, 1.5
SIG_KEEP, SYN_KEEP, EXP_KEEP = 60, 12, 40
# fixed values: alignment of word groups to meanings
HOOD = {"member": 1.0, "similar": 0.8, "also": 0.8, "hypernym": 0.6, "hyponym": 0.4, "definition": 0.5}
PHRASE_FACTOR, CONTEXT_FACTOR, CONTEXT_CAP = 0.5, 0.25, 1.0
MIN_SCORE, MIN_GROUP, MARGIN, UPSET = 1.0, 0.4, 0.2, 1.5
# fixed values: weight of the lexicon itself and of any other source in synonym ranking
MAIN_WEIGHT, OTHER_WEIGHT = 3.0, 1.0

# fixed values: sound folds on a-z, in order
SOUND_FOLDS = (
    ("^kn", "n"), ("^gn", "n"), ("^wr", "r"), ("^ps", "s"), ("^wh", "w"), ("mb$", "m"), ("dge", "j"), ("tch", "ch"),
    ("ck", "k"), ("ph", "f"), ("gh", ""), ("qu", "kw"), ("x", "ks"), ("sch", "sk"), ("c([eiy])", "s$1"), ("g([eiy])", "j$1"),
    ("c", "k"), ("q", "k"), ("sh", "S"), ("ch", "C"), ("th", "T"), ("z", "s"), ("v", "f"),
)

# fixed values: suffix rules (part of speech, suffix, replacement), in order
SUFFIX_RULES = (
    ("n", "s", ""), ("n", "ses", "s"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"),
    ("n", "ies", "y"), ("n", "oes", "o"), ("n", "ves", "f"), ("n", "ves", "fe"), ("n", "men", "man"),
    ("v", "s", ""), ("v", "es", ""), ("v", "es", "e"), ("v", "ies", "y"), ("v", "ed", ""), ("v", "ed", "e"),
    ("v", "ied", "y"), ("v", "ing", ""), ("v", "ing", "e"), ("v", "ying", "ie"),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"), ("a", "ier", "y"), ("a", "iest", "y"),
    ("r", "er", ""), ("r", "est", ""), ("r", "ier", "y"), ("r", "iest", "y"),
)
#: Suffixes whose stem may have a doubled last consonant.
DOUBLING = {"v": ("ed", "ing"), "a": ("er", "est"), "r": ("er", "est")}
