"""Operators on images, matches, contours and models."""
