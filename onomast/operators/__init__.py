"""Stages as DataFrame -> DataFrame functions."""
