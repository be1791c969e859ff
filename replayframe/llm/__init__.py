"""Operators for preparing language-model training corpora.

Every operator is a ``DataFrame -> DataFrame`` function with its own module;
``queries`` registers one thin query per operator.  Nothing outside this
subpackage imports it.
"""
