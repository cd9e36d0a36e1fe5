"""Query language: parser and match plans."""
