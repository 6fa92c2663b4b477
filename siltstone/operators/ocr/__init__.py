"""Character recognition: pixel kernels, layout, glyph features and recognition, language ranking."""
