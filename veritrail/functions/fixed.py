"""Word lists, phrases and patterns that results depend on."""

CONTRACTIONS = (
    "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "couldn't",
    "shouldn't", "isn't", "aren't", "wasn't", "weren't", "hasn't",
    "haven't", "hadn't", "i'm", "i've", "i'd", "i'll", "we're", "we've",
    "we'd", "we'll", "you're", "you've", "you'd", "you'll", "they're",
    "they've", "they'd", "they'll", "he's", "she's", "it's", "that's",
    "there's", "here's", "what's", "who's", "let's", "ain't",
)
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "am", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "need",
    "dare", "ought", "used", "it", "its", "this", "that", "these", "those",
    "i", "me", "my", "mine", "we", "us", "our", "ours", "you", "your",
    "yours", "he", "him", "his", "she", "her", "hers", "they", "them",
    "their", "theirs", "what", "which", "who", "whom", "where", "when",
    "how", "not", "no", "nor", "as", "if", "so", "than", "too", "very",
    "just", "about", "above", "after", "again", "all", "also", "any",
    "because", "before", "between", "both", "each", "few", "more", "most",
    "other", "over", "own", "same", "some", "such", "then", "through",
    "under", "until", "up", "while",
)
TRANSITIONS = (
    "furthermore", "moreover", "in conclusion", "consequently", "additionally", "however", "therefore", "thus", "to summarize", "ultimately", "firstly", "secondly",
    "delving into", "it is important to note", "crucially", "in essence", "at its core", "all in all", "taking everything into consideration", "it is worth noting that",
    "one could argue", "to begin with", "in this essay", "we will explore", "the landscape of", "the realm of", "navigating the complexities", "multifaceted",
    "a critical aspect of", "prior to", "subsequently",
)
PERSONAL_VOICE = (
    "i", "my", "me", "mine", "we", "our", "us", "experience", "felt", "think", "believe", "notice", "remember", "guess", "maybe", "probably", "honestly", "hopefully",
    "personally", "actually", "literally", "kind of", "basically",
)
GENERIC_PHRASES = (
    "can be defined as", "plays a crucial role", "is a multifaceted", "has garnered significant attention", "landscape of", "realm of", "let's dive in", "in today's fast-paced",
    "a testament to", "ever-evolving", "rapidly changing", "technological advancements", "significant impact", "profound effect", "vital component", "not merely", "but also",
    "stands as a", "shed light on", "delve deeper", "uncover", "transformative", "seamless",
)
#: Each removed once at the start of a text, in this order, letters in either case.
LEAKAGE = (
    r"^as an ai( language model)?,?\s*",
    r"^i'?d be happy to help[.!]?\s*",
    r"^sure[,!]?\s*(here'?s?|i can|let me)\s*",
    r"^certainly[,!]?\s*(here'?s?|i can|let me)\s*",
    r"^of course[,!]?\s*(here'?s?|i can|let me)\s*",
    r"^absolutely[,!]?\s*(here'?s?|i can|let me)\s*",
    r"^great question[.!]?\s*",
    r"^that'?s a (great|good|interesting) question[.!]?\s*",
    r"^here is (a |an |my |the )?(essay|response|answer|text).*?:\s*",
    r"^(title|essay|response|answer)\s*:\s*",
)
#: The 18 features, in the model's order.
FEATURES = (
    "mean_perplexity", "perplexity_variance", "entropy", "avg_sentence_length", "sentence_length_std", "type_token_ratio", "stop_word_ratio", "punctuation_frequency",
    "contraction_ratio", "noun_ratio", "verb_ratio", "adjective_ratio", "named_entity_density", "avg_paragraph_length", "flesch_reading_ease", "generic_phrasing",
    "lack_of_personal_voice", "over_structured_coherence",
)
