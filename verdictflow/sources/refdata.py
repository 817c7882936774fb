"""Reference relations: standard modules and import aliases.  Both are small and fixed, so joins may broadcast them."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

# Standard modules that some interpreter versions lack, and one counted as standard.
OTHER_VERSIONS = (
    "_android_support _colorize _interpchannels _interpqueues _interpreters _ios_support _opcode_metadata _pydatetime _pyrepl _suggestions _sysconfig _tokenize _typing _wmi tomllib "
    "_apple_support _ast_unparse _crypt _hmac _math_integer _msi _py_warnings _remote_debugging _types _zstd aifc annotationlib asynchat asyncore "
    "audioop binhex cgi cgitb chunk compression crypt distutils formatter imghdr imp lib2to3 mailcap msilib nis nntplib ossaudiodev parser pipes "
    "profiling smtpd sndhdr spwd sunau symbol telnetlib typing_extensions uu xdrlib"
)

# Import name to distribution name.
ALIASES = {
    "attr": "attrs", "bs4": "beautifulsoup4", "cairo": "pycairo", "Crypto": "pycryptodome", "cv2": "opencv-python",
    "dateutil": "python-dateutil", "dns": "dnspython", "docx": "python-docx", "dotenv": "python-dotenv", "fitz": "PyMuPDF",
    "gi": "PyGObject", "git": "GitPython", "google": "protobuf", "grpc": "grpcio", "grpc_tools": "grpcio-tools",
    "jaraco": "jaraco.classes", "jose": "python-jose", "jwt": "PyJWT", "ldap": "python-ldap", "Levenshtein": "python-Levenshtein",
    "magic": "python-magic", "memcache": "python-memcached", "mpl_toolkits": "matplotlib", "multipart": "python-multipart",
    "MySQLdb": "mysqlclient", "nacl": "PyNaCl", "OpenGL": "PyOpenGL", "OpenSSL": "pyOpenSSL", "opentelemetry": "opentelemetry-api",
    "PIL": "Pillow", "pkg_config": "pkgconfig", "pkg_resources": "setuptools", "pptx": "python-pptx", "pythoncom": "pywin32",
    "pywintypes": "pywin32", "win32api": "pywin32", "win32com": "pywin32", "win32con": "pywin32", "_pytest": "pytest",
    "repoze": "repoze.lru", "ruamel": "ruamel.yaml", "serial": "pyserial", "skimage": "scikit-image", "sklearn": "scikit-learn",
    "slugify": "python-slugify", "snappy": "python-snappy", "sphinxcontrib": "sphinxcontrib-applehelp", "usb": "pyusb",
    "Xlib": "python-xlib", "yaml": "PyYAML", "zmq": "pyzmq",
}


def stdlib_names() -> list[str]:
    """The interpreter's own list and the names of other versions, so that no version's modules are missing."""
    return sorted(set(sys.stdlib_module_names) | set(OTHER_VERSIONS.split()))


def stdlib(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in stdlib_names()], "name string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(ALIASES.items()), "import_name string, dist string")
