"""Word lists, patterns and code-point ranges that results depend on."""

from __future__ import annotations

from itertools import chain

# Regular-expression classes that make Java patterns agree with Unicode-aware \w and \s.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SPACE_NOT_BLANK = r"[\s\x1c-\x1f\x85\p{Z}&&[^ ]]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD_NOT_SPACE = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"

# Emoji blocks removed by remove_emoji: emoticons, pictographs, transport, flags.
EMOJI_BLOCKS = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"

# CSV fields read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Contractions: built from subjects and auxiliaries, plus the irregular and informal ones.
_SUBJECT_FORMS = {
    "i": ["'m am", "'ll will", "'ve have", "'d would"],
    "you": ["'re are", "'ll will", "'ve have", "'d would"],
    "he": ["'s is", "'ll will", "'d would"],
    "she": ["'s is", "'ll will", "'d would"],
    "it": ["'s is", "'ll will", "'d would"],
    "we": ["'re are", "'ll will", "'ve have", "'d would"],
    "they": ["'re are", "'ll will", "'ve have", "'d would"],
    "who": ["'s is", "'ll will", "'d would"],
    "that": ["'s is", "'ll will", "'d would"],
    "there": ["'s is", "'ll will", "'d would"],
    "what": ["'s is", "'re are", "'ll will"],
    "where": ["'s is"],
    "how": ["'s is"],
}
_NEGATED = [
    "are", "could", "did", "does", "do", "had", "has", "have", "is", "might", "must", "need",
    "should", "was", "were", "would",
]
_IRREGULAR = {
    "ain't": "are not", "can't": "cannot", "shan't": "shall not", "won't": "will not",
    "let's": "let us", "y'all": "you all", "ma'am": "madam", "o'clock": "of the clock",
    "'cause": "because", "'tis": "it is", "'twas": "it was",
}
INFORMAL = {
    "gonna": "going to", "gotta": "got to", "wanna": "want to", "gimme": "give me",
    "lemme": "let me", "dunno": "do not know", "kinda": "kind of", "u": "you", "ur": "your",
}
CONTRACTIONS = {
    **{
        subject + form.split(" ")[0]: subject + " " + form.split(" ")[1]
        for subject, forms in _SUBJECT_FORMS.items()
        for form in forms
    },
    **{verb + "n't": verb + " not" for verb in _NEGATED},
    **_IRREGULAR,
    **INFORMAL,
}

# Irregular word forms, one line per lemma; everything else goes through the suffix rules.
_IRREGULAR_FORMS = {
    "be": "am are is was were been being",
    "have": "has had having",
    "do": "does did done doing",
    "go": "goes went gone",
    "say": "says said",
    "get": "got gotten",
    "make": "made making",
    "know": "knew known",
    "think": "thought",
    "take": "took taken taking",
    "see": "saw seen",
    "come": "came coming",
    "give": "gave given giving",
    "find": "found",
    "tell": "told",
    "feel": "felt",
    "leave": "left",
    "keep": "kept",
    "begin": "began begun",
    "write": "wrote written writing",
    "run": "ran",
    "buy": "bought",
    "bring": "brought",
    "man": "men",
    "woman": "women",
    "child": "children",
    "person": "people",
    "foot": "feet",
    "tooth": "teeth",
    "mouse": "mice",
    "good": "better best",
    "bad": "worse worst",
}
LEMMA_EXCEPTIONS = {
    **{form: lemma for lemma, forms in _IRREGULAR_FORMS.items() for form in forms.split(" ")},
    # words that only look inflected
    **{
        word: word
        for word in chain(
            "thing king ring sing bring spring string during nothing something anything".split(),
            "everything morning evening bed red need seed feed speed indeed news yes his this".split(),
            "always series species".split(),
        )
    },
}

# Published headers of the metric files, by column of the metric rows.
METRIC_HEADERS = {
    "threshold": "Threshold",
    "accuracy": "Accuracy",
    "balanced_accuracy": "Balanced Accuracy",
    "f1": "F1",
    "precision": "Precision",
    "recall": "Recall (Sensitivity)",
    "specificity": "Specificity",
    "npv": "Negative Predictive Value",
    "mcc": "MCC",
    "kappa": "Cohen Kappa",
    "roc_auc": "ROC-AUC",
    "pr_auc": "PR-AUC",
    "precision_macro": "Precision (macro)",
    "recall_macro": "Recall (macro)",
    "f1_macro": "F1 (macro)",
    "roc_auc_ovr": "ROC-AUC (ovr)",
}
