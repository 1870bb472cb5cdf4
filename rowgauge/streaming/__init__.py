"""The same row flags over a stream of files."""
