"""Training-data operators: quality, near-duplicates, language models, URL
lists, vector search, mixing, decontamination, licences, languages and
repeated passages.  Nothing else in the library imports this subpackage."""
