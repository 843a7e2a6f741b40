"""Part of voxtile; see README.md."""
