"""Training-data operators over tables of documents; nothing else in the library imports this subpackage."""
