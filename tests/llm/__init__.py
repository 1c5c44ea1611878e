"""Tests of the training-data operators (a package, so that file names may repeat those of ``tests/``)."""
