"""Operators for preparing training corpora. Nothing else in meshwind imports this subpackage."""
