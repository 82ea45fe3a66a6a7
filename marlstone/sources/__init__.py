"""Readers and writers: manifests, evaluation sets, image folders, the versioned index."""
