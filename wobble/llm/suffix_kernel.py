"""Suffix sorting by linear grouping, as a JVM function.

The algorithm is the two-phase grouping construction of Baier ("Linear-time suffix sorting", 2016), written here for
a collection of byte strings with a separator after each. Phase 1 refines groups of suffixes until a group is all
suffixes with the same Lyndon prefix. It goes through groups in descending order; each suffix of a group gets a
pointer to the previous suffix of a lower group, found by following the pointers of higher groups, and the suffixes
pointed to leave their group upwards, those with more pointers further. Phase 2 goes through the order from its
start and places, for each suffix, those before it along the pointers at the next free places of their groups. No
suffix is renamed and nothing recurs.

Neighbours in that order are then compared over ``length`` bytes, and what is returned are the byte ranges of each
string that a window of that length covers which also starts elsewhere in the collection.

The class is compiled in memory by the compiler that Spark itself ships, and added to the session as a jar, so
executors get it from the driver.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

CLASS = "wobble.RepeatedRanges"
SOURCE = """
package wobble;

/** Byte strings -> flat triples (string, from, to) of the ranges that repeated windows cover. */
public class RepeatedRanges implements org.apache.spark.sql.api.java.UDF2 {
  public Object call(Object strings, Object windowLength) {
    int window = ((Integer) windowLength).intValue();
    int n = 0;
    int count = 0;
    scala.collection.Iterator it = ((scala.collection.Seq) strings).iterator();
    while (it.hasNext()) { n += ((byte[]) it.next()).length + 1; count++; }
    short[] text = new short[n];
    int[] begin = new int[count + 1];
    int at = 0;
    int k = 0;
    it = ((scala.collection.Seq) strings).iterator();
    while (it.hasNext()) {
      byte[] b = (byte[]) it.next();
      begin[k++] = at;
      for (int i = 0; i < b.length; i++) text[at++] = (short) ((b[i] & 255) + 1);
      text[at++] = 0;
    }
    begin[count] = at;
    int[] order = sorted(text);
    boolean[] repeated = new boolean[n];
    markRepeated(text, order, begin, window, repeated);
    int[] out = new int[64];
    int used = 0;
    for (int s = 0; s < count; s++) {
      int from = -1;
      int to = -1;
      for (int i = begin[s]; i < begin[s + 1]; i++) {
        if (!repeated[i]) continue;
        if (from >= 0 && i <= to) { to = i + window; continue; }
        if (from >= 0) { out = put(out, used, s, from - begin[s], to - begin[s]); used += 3; }
        from = i;
        to = i + window;
      }
      if (from >= 0) { out = put(out, used, s, from - begin[s], to - begin[s]); used += 3; }
    }
    int[] exact = new int[used];
    System.arraycopy(out, 0, exact, 0, used);
    return exact;
  }

  static int[] put(int[] out, int used, int a, int b, int c) {
    if (used + 3 > out.length) {
      int[] more = new int[out.length * 2];
      System.arraycopy(out, 0, more, 0, used);
      out = more;
    }
    out[used] = a;
    out[used + 1] = b;
    out[used + 2] = c;
    return out;
  }

  /** Starts of all suffixes in lexicographic order, the end being below every character. */
  static int[] sorted(short[] text) {
    int n = text.length;
    int[] sa = new int[n];     // suffixes, group after group
    int[] place = new int[n];  // of each suffix in sa
    int[] group = new int[n];  // of each suffix: the group's first place
    int[] size = new int[n + 1];  // of the group that begins at a place
    int[] prev = new int[n];   // nearest suffix to the left in a lower group
    int[] first = new int[258];
    for (int i = 0; i < n; i++) first[text[i] + 1]++;
    for (int c = 0; c < 257; c++) first[c + 1] += first[c];
    int[] next = new int[257];
    System.arraycopy(first, 0, next, 0, 257);
    for (int i = 0; i < n; i++) {
      int p = next[text[i]]++;
      sa[p] = i;
      place[i] = p;
      group[i] = first[text[i]];
      size[first[text[i]]]++;
    }
    int[] pointed = new int[n];  // suffixes that the present group points to
    int[] times = new int[n];    // how often each is pointed to
    int[] bySize = new int[n];
    int high = n;
    while (high > 0) {
      int low = group[sa[high - 1]];
      // pointers that stop at the group itself first, so that the order of its members does not matter
      for (int p = low; p < high; p++) {
        int j = sa[p] - 1;
        while (j >= 0 && group[j] > low) j = prev[j];
        prev[sa[p]] = j;
      }
      int found = 0;
      int most = 0;
      for (int p = low; p < high; p++) {
        int i = sa[p];
        int j = prev[i];
        while (j >= 0 && group[j] == low) j = prev[j];
        // short cuts for the members passed on the way
        int m = i;
        while (m >= 0 && m != j && group[m] == low) { int up = prev[m]; prev[m] = j; m = up; }
        if (j >= 0) {
          if (times[j]++ == 0) pointed[found++] = j;
          if (times[j] > most) most = times[j];
        }
      }
      // by falling number of pointers
      int[] from = new int[most + 2];
      for (int q = 0; q < found; q++) from[most - times[pointed[q]] + 1]++;
      for (int q = 0; q <= most; q++) from[q + 1] += from[q];
      int[] fill = new int[most + 1];
      for (int q = 0; q < found; q++) {
        int c = most - times[pointed[q]];
        bySize[from[c] + fill[c]++] = pointed[q];
      }
      for (int c = 0; c < most; c++) {
        for (int q = from[c]; q < from[c + 1]; q++) {
          int j = bySize[q];
          int g = group[j];
          int last = g + --size[g];
          int other = sa[last];
          int p = place[j];
          sa[last] = j;
          place[j] = last;
          sa[p] = other;
          place[other] = p;
        }
        for (int q = from[c]; q < from[c + 1]; q++) {
          int j = bySize[q];
          group[j] = group[j] + size[group[j]];
        }
        for (int q = from[c]; q < from[c + 1]; q++) size[group[bySize[q]]]++;
      }
      for (int q = 0; q < found; q++) times[pointed[q]] = 0;
      high = low;
    }
    int[] used = times;  // all zero: places filled of each group
    boolean[] done = new boolean[n];
    for (int r = -1; r < n; r++) {
      int j = (r < 0 ? n : sa[r]) - 1;
      while (j >= 0 && !done[j]) {
        done[j] = true;
        sa[group[j] + used[group[j]]++] = j;
        j = prev[j];
      }
    }
    return sa;
  }

  static void markRepeated(short[] text, int[] order, int[] begin, int window, boolean[] repeated) {
    int n = text.length;
    int[] rank = new int[n];
    for (int r = 0; r < n; r++) rank[order[r]] = r;
    boolean[] live = new boolean[n];  // a window of its string starts there
    for (int s = 0; s + 1 < begin.length; s++)
      for (int i = begin[s]; i + window < begin[s + 1]; i++) live[i] = true;
    int h = 0;
    for (int i = 0; i < n; i++) {
      if (rank[i] == 0) { h = 0; continue; }
      int j = order[rank[i] - 1];
      while (h < window && i + h < n && j + h < n && text[i + h] == text[j + h]) h++;
      if (h == window && live[i] && live[j]) { repeated[i] = true; repeated[j] = true; }
      if (h > 0) h--;
    }
  }
}
"""


def registered(spark: SparkSession, name: str = "wobble_repeated_ranges") -> str:
    """The name of the SQL function; compiles, ships and registers it where the session does not have it."""
    context = spark.sparkContext
    jvm = context._jvm
    if not getattr(context, "_wobble_kernel", None):
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE)
        folder = tempfile.mkdtemp(prefix="wobble-jar-")  # the driver's own: executors get the jar from it
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = Path(folder) / "wobble-kernel.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for cls, code in dict(compiler.getBytecodes()).items():
                z.writestr(cls.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(str(jar))  # the driver serves it to executors
        context._wobble_kernel = compiler.getClassLoader().loadClass(CLASS)
    kind = context._jvm.org.apache.spark.sql.types.DataType.fromJson(T.ArrayType(T.IntegerType(), False).json())
    spark._jsparkSession.udf().register(name, context._wobble_kernel.getDeclaredConstructor(None).newInstance(None), kind)
    return name
