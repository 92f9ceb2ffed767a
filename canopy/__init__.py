"""Neighbour graphs, spanning trees and tree maps as Spark DataFrame programs."""

__version__ = "0.1.0"
