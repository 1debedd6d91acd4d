"""The words left out of vocabulary counts."""

STOPWORDS = (
    "the", "and", "you", "that", "this", "for", "but", "not", "with", "was",
    "are", "have", "had", "just", "what", "your", "its", "it's", "can", "will",
    "get", "got", "all", "out", "too", "then", "than", "they", "them", "there",
    "when", "how", "who", "why", "yes", "yeah", "okay", "one", "him", "her",
    "his", "she", "he's", "i'm", "i'll", "don't", "didn't", "were",
    "that's", "it'll", "you're", "i've", "can't", "won't", "she's",
    "there's", "we're", "they're", "isn't", "what's", "let's", "i'd",
)
