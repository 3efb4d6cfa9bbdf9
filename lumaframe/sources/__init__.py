"""Readers and writers of images, animations, sequences and weights."""
