"""Explicit schemas, so that no reader runs an inference pass."""

CRAWLED_PAGE = "orig_domain string, domain string, categories string, text string"

SEED = "domain string, categories string"

TOPIC_PAGE = (
    "uri string, origUri string, categories array<string>, "
    "text string, origCategories array<string>"
)

RULE = "name string, filters struct<includes: array<string>, excludes: array<string>>"

VOCABULARY = "word string, id int"

FEATURE = "uri string, origUri string, paddedWords array<int>, category array<int>"

CLASS_WEIGHTS = "name string, weights map<string, double>"

DIRECTORY_PAGE = "_about string, topic string"

QUESTION = (
    "question_index int, question_family_index int, image_index int, "
    "question string, answer string, image_filename string, split string"
)
